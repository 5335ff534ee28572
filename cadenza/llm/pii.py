"""Personal data and secrets by bootstrapped contextual extraction, in DataFrame functions only.

Base entities (e-mail, IP, card, phone) come from patterns and checks. They are seeds, as are secrets: values of
public key formats and values assigned to words such as password. Every seed, and every other token with
a digit, @ or = (a candidate), stands in lexical patterns: the two words before it, the word on either side, the
name it is assigned to, and, for long tokens, its shape (class of characters, fixed prefix, length).

Spark scores the graph of patterns and instances in rounds. A pattern's confidence in a kind is the share of
its instances that are trusted as that kind; an instance's score grows with the confidence of its
patterns (noisy or). Instances above CONFIDENT become trusted, so they induce patterns of their own in the
next round, until a round adds none. Confident patterns then add the trusted instances as further spans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, text_or_empty

KINDS = ("email", "ip", "card", "phone")
#: Names by number; the last one has no base pattern. Candidates come after them.
NAMES = (*KINDS, "secret")
SECRET, CANDIDATES = len(KINDS), len(NAMES)
#: Possessive forms of the base patterns: the same matches without backtracking into long runs. A match
#: starts at the begin of a run of its first class, or where the match before it ended.
PATTERNS = (
    r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    r"[0-9](?:[\x20-]?[0-9])++",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)
#: Any token with a digit, @ or = may turn out to be an identifier, but not a sign alone.
CANDIDATE = r"(?<!\S)(?=[^\s\p{L}\p{N}]*+[\p{L}\p{N}])[^\s0-9@=]*+[0-9@=]\S*+"
#: A name that the token assigns to, with its sign, and opening marks; closing marks.
ASSIGNED, OPEN, CLOSE = r"^[A-Za-z][A-Za-z0-9_.-]{0,63}+(?:=>|:=|[=:])(?!//)", r"^[\"'`(\[{<]*+", "\"'`)]}>.,;:!?"
#: Names whose values are secrets (from LEAST_SECRET characters), and public formats of keys: fixed values.
SECRET_NAME = r"(?:^|[._-])(?:password|passwd|pwd|secret|token|api[._-]?key|access[._-]?key|auth)$"
SECRET_FORMAT = r"^(?:(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36}|AIza[0-9A-Za-z_-]{35}|xox[abprs]-[0-9A-Za-z-]{10,}|sk_live_[0-9A-Za-z]{16,})$"
LEAST_SECRET = 8
#: Characters of context, trusted instances that a pattern needs, rounds at most, least confidence of patterns and instances.
CONTEXT, SEEDS, ROUNDS, CONFIDENT = 80, 4, 20, 0.8

_BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"


def luhn(digits: Column) -> Column:
    """Whether a text of digits passes the Luhn check."""
    places = F.transform(F.sequence(F.lit(1), F.length(digits)), lambda i: F.substring(F.reverse(digits), i, F.lit(1)).cast("int"))
    doubled = F.transform(places, lambda d, i: F.when(i % 2 == 0, d).when(d > 4, d * 2 - 9).otherwise(d * 2))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d) % 10 == 0


def valid(kind: Column, value: Column) -> Column:
    """The checks on a match: parts of an address, digits of a card or phone; candidates always pass."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    count = F.length(digits)
    return (
        F.when(kind == 1, value.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$"))
        .when(kind == 2, F.when((count >= 16) & (count <= 19), luhn(digits)).otherwise(False))
        .when(kind == 3, (count >= 8) & (count <= 15))
        .otherwise(True)
    )


def occurrences(docs: DataFrame) -> DataFrame:
    """row_no, doc_id, kind, start, stop, value, l2, l1, r1, name of every match that holds; kind CANDIDATES: other tokens.

    start and stop are code points, stop exclusive. Candidates are bare of marks around them and of the name
    they are assigned to. A row without matches is there once, kind null. Starts come from the lengths of the
    gaps that split() leaves between the matches.
    """
    t = F.col("t")
    # Cheap conditions keep most texts from the costlier patterns.
    digit = t.rlike("[0-9]")
    any_ = digit | F.contains(t, F.lit("@")) | F.contains(t, F.lit("="))
    when = (F.contains(t, F.lit("@")), digit, digit, F.contains(t, F.lit("+")), any_)
    rows = docs.select(F.monotonically_increasing_id().alias("row_no"), "doc_id", text_or_empty(F.col("text")).alias("t"))

    def gap(x: Column) -> Column:
        return F.struct(
            F.length(x).cast("long").alias("size"),
            F.substring(x, -CONTEXT, CONTEXT).alias("tail"),
            F.substring(x, 1, CONTEXT).alias("head"),
        )

    found, gaps = [], []
    for n, (pattern, there) in enumerate(zip((*PATTERNS, CANDIDATE), when, strict=True)):
        found.append(F.when(there, F.regexp_extract_all(t, F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>")).alias(f"m{n}"))
        kind = "array<struct<size:bigint,tail:string,head:string>>"
        gaps.append(F.when(there, F.transform(F.split(t, pattern, -1), gap)).otherwise(F.array().cast(kind)).alias(f"g{n}"))
    split = rows.select("row_no", "doc_id", *found, *gaps)

    def items(n: int) -> Column:
        """The matches of one pattern with the text around them, other matches of the pattern included: two words before need two of them."""
        matches, between = F.col(f"m{n}"), F.col(f"g{n}")
        near = lambda i: F.substring(F.coalesce(F.get(matches, i), F.lit("")), -CONTEXT, CONTEXT)
        tail = lambda i: F.coalesce(F.get(between, i)["tail"], F.lit(""))

        def item(value: Column, i: Column) -> Column:
            before = F.concat(tail(i - 2), near(i - 2), tail(i - 1), near(i - 1), tail(i))
            after = F.concat(F.get(between, i + 1)["head"], F.substring(F.coalesce(F.get(matches, i + 1), F.lit("")), 1, CONTEXT))
            return F.struct(
                F.lit(n).alias("kind"), F.get(between, i)["size"].alias("gap"), value.alias("value"),
                F.substring(before, -CONTEXT, CONTEXT).alias("tail"), F.substring(after, 1, CONTEXT).alias("head"),
            )

        return F.transform(matches, item)

    each = split.select("row_no", "doc_id", F.posexplode_outer(F.concat(*[items(n) for n in range(len(KINDS) + 1)])).alias("pos", "x"))
    each = each.select("row_no", "doc_id", "pos", "x.*")
    line = Window.partitionBy("row_no", "kind").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    stop = F.sum(F.col("gap") + F.length("value")).over(line)
    before, after = F.split(F.trim(F.lower("tail")), r"\s+"), F.split(F.trim(F.lower("head")), r"\s+")
    placed = each.withColumn("kind", F.when(F.col("kind") == len(KINDS), CANDIDATES).otherwise(F.col("kind"))).select(
        "row_no", "doc_id", "kind", (stop - F.length("value")).alias("start"), stop.alias("stop"), "value",
        F.nullif(F.try_element_at(before, F.lit(-2)), F.lit("")).alias("l2"),
        F.nullif(F.try_element_at(before, F.lit(-1)), F.lit("")).alias("l1"),
        F.nullif(F.try_element_at(after, F.lit(1)), F.lit("")).alias("r1"),
    )
    fails = F.col("kind").isNotNull() & ~valid(F.col("kind"), F.col("value"))
    # A row all of whose matches fail must still be there.
    return _bare(placed.withColumn("kind", F.when(~fails, F.col("kind"))))


def _bare(spans: DataFrame) -> DataFrame:
    """spans with name (what the value is assigned to), candidates reduced to their values, seeds of secrets marked."""
    open_ = F.col("kind") == CANDIDATES
    sign = F.when(open_, F.regexp_extract("value", ASSIGNED, 0)).otherwise("")
    rest = F.substring("value", F.length("sign") + 1, 1 << 30)
    marks = F.when(open_, F.regexp_extract("rest", OPEN, 0)).otherwise("")
    inner = F.substring("rest", F.length("marks") + 1, 1 << 30)
    # A value in quotes ends at the closing one, whatever follows it.
    inner = F.when(F.col("marks").rlike("[\"'`]$"), F.split_part(inner, F.right("marks", F.lit(1)), F.lit(1))).otherwise(inner)
    value = F.when(open_, F.rtrim(inner, F.lit(CLOSE))).otherwise(F.col("value"))
    parts = spans.withColumn("sign", sign).withColumn("rest", rest).withColumn("marks", marks).withColumn("value", value)
    start = F.col("start") + F.length("sign") + F.length("marks")
    before = F.when(F.col("l1").isin("=", ":", ":=", "=>"), F.col("l2")).when(F.col("l1").rlike("[=:]$"), F.col("l1"))
    name = F.lower(F.trim(F.coalesce(F.nullif("sign", F.lit("")), before), F.lit("\"'`=:>")))
    stop = F.when(open_, start + F.length("value")).otherwise(F.col("stop"))
    parts = parts.withColumns({"start": F.when(open_, start).otherwise(F.col("start")), "stop": stop, "name": F.nullif(name, F.lit(""))})
    secret = (F.coalesce(F.col("name").rlike(SECRET_NAME), F.lit(False)) & (F.length("value") >= LEAST_SECRET)) | F.col("value").rlike(SECRET_FORMAT)
    kind = F.when(~open_, F.col("kind")).when(F.col("value") == "", F.lit(None)).when(secret, SECRET).otherwise(F.col("kind"))
    return parts.withColumn("kind", kind).drop("sign", "rest", "marks")


def _free_candidates(spans: DataFrame) -> DataFrame:
    """Candidates and secrets that overlap no base span of their row."""
    base = F.col("kind") < SECRET
    up = Window.partitionBy("row_no").orderBy("start", F.desc("kind")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    down = Window.partitionBy("row_no").orderBy(F.desc("start"), "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reached = spans.withColumn("reached", F.max(F.when(base, F.col("stop"))).over(up)).withColumn("next_start", F.min(F.when(base, F.col("start"))).over(down))
    free = (F.coalesce("reached", F.lit(-1)) <= F.col("start")) & (F.coalesce("next_start", F.col("stop")) >= F.col("stop"))
    return reached.filter((F.col("kind") >= SECRET) & free).drop("reached", "next_start")


def _shape(value: Column) -> Column:
    """Class, fixed prefix and length of a token of 16 characters or more; null for others."""
    size = F.length(value).cast("string")
    return (
        F.when(value.rlike("^[0-9a-f]{16,}$") & value.rlike("[a-f]"), F.concat(F.lit("hex "), size))
        .when(value.rlike("^[A-Z]{4}[A-Z0-9]{12,}$"), F.concat(F.lit("upper "), F.substring(value, 1, 4), F.lit(" "), size))
        .when(value.rlike("^[A-Za-z]{2,8}[_-][A-Za-z0-9_-]{13,}$"), F.concat(F.lit("word "), F.regexp_extract(value, "^[A-Za-z]+[_-]", 0), F.lit(" "), size))
    )


def _contexts(spans: DataFrame) -> DataFrame:
    """One row per span and lexical pattern; id stands for the value, which may be long."""
    two = F.when(F.col("l2").isNotNull(), F.concat("l2", F.lit(" "), "l1", F.lit(" *")))
    sides = F.when(F.col("l1").isNotNull() & F.col("r1").isNotNull(), F.concat("l1", F.lit(" * "), "r1"))
    assigned = F.concat("name", F.lit(" = *"))
    shape = F.when(F.col("kind") >= SECRET, F.concat(F.lit("* is "), _shape(F.col("value"))))
    each = spans.select("row_no", "kind", "start", "stop", F.md5("value").alias("id"), F.explode(F.array(two, sides, assigned, shape)).alias("pattern"))
    return each.filter(F.col("pattern").isNotNull())


def discover(base: DataFrame, free: DataFrame, seeds: int = SEEDS, rounds: int = ROUNDS, confident: float = CONFIDENT) -> DataFrame | None:
    """row_no, kind, start, stop of the candidates that confident patterns add; None if no pattern has enough seeds.

    base and free: spans of base kinds, and secrets and candidates apart from them. Hot patterns cost one row per
    distinct instance, as edges are made distinct before they are joined. A pattern counts with seeds or more
    trusted instances and a confidence of a half; trusted + 1 instances are the least it is divided by.
    """
    seen = _contexts(base.unionByName(free))
    edges = checkpoint(seen.select("pattern", "id", "kind").distinct())
    size = edges.groupBy("pattern").agg(F.countDistinct("id").alias("size"))
    open_ = edges.filter(F.col("kind") == CANDIDATES).select("pattern", "id")
    # Candidates are of interest where something can be learned about them: patterns of one instance are no evidence.
    size = checkpoint(size.filter(F.col("size") > seeds))
    open_ = checkpoint(open_.join(size, "pattern"))
    trusted = edges.filter(F.col("kind") < CANDIDATES).join(size, "pattern").select("pattern", "size", "id", F.col("kind").alias("as_kind"), F.lit(1.0).alias("score"))
    trusted = checkpoint(trusted)
    found, known, confidence = trusted, 0, None
    for _ in range(rounds):
        sums = found.groupBy("pattern", "as_kind", "size").agg(F.sum("score").alias("total"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= seeds)
        confidence = sums.select("pattern", "as_kind", (F.col("total") / (F.col("size") + 1)).alias("confidence")).filter(F.col("confidence") >= 0.5)
        confidence = checkpoint(confidence)
        doubt = F.exp(F.sum(F.log(F.greatest(F.lit(1e-9), 1 - F.col("confidence")))))
        instances = open_.join(confidence, "pattern").groupBy("id", "as_kind").agg((1 - doubt).alias("score"))
        instances = checkpoint(instances.filter(F.col("score") >= confident))
        now = instances.count()
        if now == known:
            break
        known = now
        found = trusted.unionByName(open_.join(instances, "id").select("pattern", "size", "id", "as_kind", "score"))
    if not known:
        return None
    sure = confidence.filter(F.col("confidence") >= confident)
    hits = seen.filter(F.col("kind") == CANDIDATES).join(sure, "pattern").join(instances.select("id", "as_kind"), ["id", "as_kind"])
    best = F.max(F.struct("confidence", (-F.col("as_kind")).alias("least")))
    return hits.groupBy("row_no", "start", "stop").agg(best.alias("best")).select("row_no", (-F.col("best.least")).cast("int").alias("kind"), "start", "stop")


def find(docs: DataFrame, seeds: int = SEEDS, rounds: int = ROUNDS, confident: float = CONFIDENT) -> DataFrame:
    """One row per row of docs: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added.

    The counts and base_sha256 are of base spans; spans lists base and added ones (secrets and discovered
    ones, n_added of them) as kind:start:stop, by kind as in NAMES, then start, comma-joined. A null text counts as empty; a text without spans has
    the empty list. Whole texts are read. Rows that repeat or lack a doc_id are each returned. An empty
    table gives an empty result. Other columns are not read.
    """
    spans = checkpoint(occurrences(docs))
    base = spans.filter(F.col("kind").isNull() | (F.col("kind") < SECRET)).select("row_no", "doc_id", "kind", "start", "stop", F.lit(False).alias("added"))
    rest = spans.filter(F.col("kind") >= SECRET).select("row_no", "doc_id", F.lit(None).cast("int").alias("kind"), "start", "stop", F.lit(False).alias("added"))
    free = checkpoint(_free_candidates(spans.filter(F.col("kind").isNotNull())))
    secrets = free.filter(F.col("kind") == SECRET).select("row_no", "doc_id", "kind", "start", "stop", F.lit(True).alias("added"))
    every = base.unionByName(rest.dropDuplicates(["row_no"])).unionByName(secrets)
    extra = discover(spans.filter(F.col("kind") < SECRET), free, seeds, rounds, confident)
    if extra is not None:
        ids = free.select("row_no", "doc_id").dropDuplicates(["row_no"])
        every = every.unionByName(extra.join(ids, "row_no").select("row_no", "doc_id", "kind", "start", "stop", F.lit(True).alias("added")))
    span = F.when(F.col("kind").isNotNull(), F.struct("kind", "start", "stop", "added"))
    listed = every.groupBy("row_no", "doc_id").agg(F.array_sort(F.collect_list(span)).alias("all"))
    names = F.array(*[F.lit(k) for k in NAMES])

    def joined(spans: Column) -> Column:
        one = lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["stop"].cast("string"))
        return F.array_join(F.transform(spans, one), ",")

    own = F.filter("all", lambda x: ~x["added"])

    def count(n: int) -> Column:
        return F.size(F.filter("all", lambda x: (x["kind"] == n) & ~x["added"])).cast("long").alias(f"n_{KINDS[n]}")

    return listed.select(
        "doc_id",
        *[count(n) for n in range(len(KINDS))],
        F.sha2(joined(own), 256).alias("base_sha256"),
        joined(F.col("all")).alias("spans"),
        F.size(F.filter("all", lambda x: x["added"])).cast("long").alias("n_added"),
    )
