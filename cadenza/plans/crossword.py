"""Queries of triphone lookup and word-edge tables: benchmark words define the triphones, turns want them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import crossword as X
from ..sources.definitions import definition_lines
from .texts import _t

FILLERS = ["q", "x", "z"]


def _phones(spark, sf_dir, table, key, text):
    """key, pos_no, phone, word: the letters a to z of each word, in order."""
    words = F.filter(F.split(F.lower(text), "[^a-z]+"), lambda w: w != "")
    each = _t(spark, sf_dir, table).select(key.alias("key"), F.posexplode(words).alias("word", "w"))
    letters = each.select("key", "word", F.posexplode(F.filter(F.split("w", ""), lambda c: c != "")).alias("p", "phone"))
    return letters.select("key", F.struct("word", "p").alias("pos_no"), "phone", "word")


def _definition(spark, sf_dir):
    """Two in three of the benchmark's triphones, and every letter: ids, and states tied by the remainder of the id."""
    seen = X.contexts(_phones(spark, sf_dir, "benchmark", F.col("item_id"), "text"), "key", FILLERS)
    triphones = seen.filter(~F.col("phone").isin(*FILLERS)).select("base", "left", "right", "pos").distinct().filter(F.crc32(F.concat("base", "left", "right", "pos").cast("binary")) % 3 != 0)
    letters = spark.range(26).select(F.chr(F.col("id") + 97).alias("base")).unionByName(spark.createDataFrame([("SIL",)], "base string"))
    base = letters.select("base", *[F.lit(None).cast("string").alias(c) for c in ("left", "right", "pos")])
    ordered = F.array_sort(F.collect_list(F.struct((F.col("left").isNotNull()).alias("more"), "base", "left", "right", "pos")))
    # As long as the triphones of a phone set, whatever the texts.
    listed = base.unionByName(triphones).agg(ordered.alias("d")).select(F.posexplode("d").alias("id", "x")).select("id", "x.base", "x.left", "x.right", "x.pos")
    state = lambda n: F.when(F.col("left").isNull(), F.col("id") * 3 + n).otherwise(100 + F.col("id") % 11 * 3 + n)
    return listed.withColumn("states", F.array(*[state(n).cast("int") for n in range(3)]))


def triphone_lookup(spark, sf_dir):
    """How often each definition serves the turns' triphones, with positions, fillers and back-off."""
    turns = _phones(spark, sf_dir, "conversations", F.struct("conv_id", "turn"), "text")
    found = X.lookup(X.contexts(turns, "key", FILLERS), _definition(spark, sf_dir), FILLERS)
    named = found.join(_definition(spark, sf_dir).select("id", *[F.col(c).alias(f"d_{c}") for c in X.KEYS]), "id", "left")
    how = F.when(F.col("d_left").isNull(), "base").when(F.col("d_pos") != F.col("pos"), "position").otherwise("exact")
    return named.groupBy("base", how.alias("how")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("d_left", "d_right", "d_pos").alias("models"))


def edge_tables(spark, sf_dir):
    """The last phones of benchmark words: how many sequences of states their right contexts need."""
    words = F.explode(F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda w: w != "")).alias("word")
    lexicon = _t(spark, sf_dir, "benchmark").select(words).distinct().select(F.filter(F.split("word", ""), lambda c: c != "").alias("phones"))
    tables = X.edge_tables(lexicon, _definition(spark, sf_dir), FILLERS)
    shown = F.array_join(F.transform("sequences", lambda s: F.element_at(s, 1).cast("string")), " ")
    places = F.aggregate(F.map_values("places"), F.lit(0).cast("long"), lambda a, p: a * 31 % 1000003 + p)
    return tables.select("base", F.coalesce("inner", F.lit("-")).alias("inner"), F.size("sequences").alias("n"), shown.alias("first_states"), F.size("places").alias("contexts"), places.alias("places"))


def definition_file(spark, sf_dir):
    """The rows of the definition's file, without their places."""
    d = _definition(spark, sf_dir).withColumns({"attrib": F.when(F.col("base").isin(*FILLERS, "SIL"), "filler"), "tmat": F.ascii("base")})
    return definition_lines(d).select("line")


DEFINITION = """bp AS (SELECT item_id AS key, unnest(list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda w: w <> '')) AS w, unnest(range(len(list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda w: w <> '')))) AS word FROM benchmark),
bl AS (SELECT key, word, unnest(range(1, length(w) + 1)) AS p, w FROM bp), bh AS (SELECT key, word, p, substr(w, CAST(p AS INTEGER), 1) AS phone FROM bl),
bc AS (SELECT phone AS base, coalesce(lag(q) OVER k, 'SIL') AS l, coalesce(lead(q) OVER k, 'SIL') AS r, lag(word) OVER k IS DISTINCT FROM word AS f, lead(word) OVER k IS DISTINCT FROM word AS e
  FROM (SELECT *, CASE WHEN phone IN ('q', 'x', 'z') THEN 'SIL' ELSE phone END AS q FROM bh) WINDOW k AS (PARTITION BY key ORDER BY word, p)),
bt AS (SELECT DISTINCT base, l, r, CASE WHEN f AND e THEN 's' WHEN f THEN 'b' WHEN e THEN 'e' ELSE 'i' END AS pos FROM bc WHERE base NOT IN ('q', 'x', 'z')),
bk AS (SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(base || l || r || pos) + 1), lambda p: CAST(ord(substr(base || l || r || pos, CAST(p AS INTEGER), 1)) AS BIGINT))),
  lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda x, n: xor(x >> 1, CASE WHEN x % 2 = 1 THEN 3988292384 ELSE 0 END))), 4294967295) % 3 AS c FROM bt),
df AS (SELECT row_number() OVER (ORDER BY l IS NOT NULL, base, l, r, pos) - 1 AS id, * FROM (SELECT base, l, r, pos FROM bk WHERE c <> 0 UNION ALL SELECT chr(CAST(i AS INTEGER)), NULL, NULL, NULL FROM range(97, 123) t(i) UNION ALL SELECT 'SIL', NULL, NULL, NULL)),
st AS (SELECT *, CASE WHEN l IS NULL THEN id * 3 ELSE 100 + id % 11 * 3 END AS state FROM df)"""
#: The definition of each row of want (base, l, r, pos): positions in the order of back-off.
NEAREST = """ord AS (SELECT * FROM (VALUES ('b', 1), ('e', 2), ('s', 3), ('i', 4)) v(pos, o)),
found AS (SELECT w.*, coalesce(
    (SELECT arg_min(d.id, CASE WHEN d.pos = w.pos THEN 0 ELSE o END) FROM df d JOIN ord ON ord.pos = d.pos WHERE d.base = w.base AND d.l = w.l AND d.r = w.r AND w.base NOT IN ('q', 'x', 'z', 'SIL')),
    (SELECT arg_min(d.id, CASE WHEN d.pos = w.pos THEN 0 ELSE o END) FROM df d JOIN ord ON ord.pos = d.pos WHERE d.base = w.base AND d.l = CASE WHEN w.l IN ('q', 'x', 'z') THEN 'SIL' ELSE w.l END AND d.r = CASE WHEN w.r IN ('q', 'x', 'z') THEN 'SIL' ELSE w.r END AND w.base NOT IN ('q', 'x', 'z', 'SIL')),
    (SELECT d.id FROM df d WHERE d.base = w.base AND d.l IS NULL)) AS id FROM want w)"""

QUERIES = {
    "definition_file": (
        definition_file,
        f"""WITH {DEFINITION}, r AS (SELECT *, CASE WHEN base IN ('q', 'x', 'z', 'SIL') THEN 'filler' ELSE 'n/a' END AS attrib, ord(base) AS tmat, unnest([state, state + 1, state + 2]) AS s FROM st),
c AS (SELECT count(*) FILTER (l IS NULL) AS b, count(l) AS t, 4 * count(*) AS m, count(DISTINCT ord(base)) AS k FROM st), e AS (SELECT count(DISTINCT s) AS s, count(DISTINCT s) FILTER (l IS NULL) AS i FROM r)
SELECT unnest(['0.3', b || ' n_base', t || ' n_tri', m || ' n_state_map', s || ' n_tied_state', i || ' n_tied_ci_state', k || ' n_tied_tmat', '# base lft rt p attrib tmat states']) AS line FROM c, e
UNION ALL SELECT printf('%5s %3s %3s %1s', base, coalesce(l, '-'), coalesce(r, '-'), coalesce(pos, '-')) || printf(' %6s', CASE WHEN base IN ('q', 'x', 'z', 'SIL') THEN 'filler' ELSE 'n/a' END) || printf(' %4d %6d %6d %6d', ord(base), state, state + 1, state + 2) || ' N' FROM st""",
    ),
    "triphone_lookup": (
        triphone_lookup,
        f"""WITH {DEFINITION}, cp AS (SELECT conv_id, turn, unnest(list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda w: w <> '')) AS w, unnest(range(len(list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda w: w <> '')))) AS word FROM conversations),
cl AS (SELECT conv_id, turn, word, unnest(range(1, length(w) + 1)) AS p, w FROM cp), ch AS (SELECT conv_id, turn, word, p, substr(w, CAST(p AS INTEGER), 1) AS phone FROM cl),
cc AS (SELECT phone AS base, coalesce(lag(q) OVER k, 'SIL') AS l, coalesce(lead(q) OVER k, 'SIL') AS r, lag(word) OVER k IS DISTINCT FROM word AS f, lead(word) OVER k IS DISTINCT FROM word AS e
  FROM (SELECT *, CASE WHEN phone IN ('q', 'x', 'z') THEN 'SIL' ELSE phone END AS q FROM ch) WINDOW k AS (PARTITION BY conv_id, turn ORDER BY word, p)),
want AS (SELECT base, l, r, CASE WHEN f AND e THEN 's' WHEN f THEN 'b' WHEN e THEN 'e' ELSE 'i' END AS pos, count(*) AS n FROM cc GROUP BY ALL), {NEAREST}
SELECT found.base, CASE WHEN df.l IS NULL THEN 'base' WHEN df.pos <> found.pos THEN 'position' ELSE 'exact' END AS how, CAST(sum(n) AS BIGINT) AS n, count(DISTINCT CASE WHEN df.l IS NOT NULL THEN df.id END) AS models FROM found JOIN df USING (id) GROUP BY ALL""",
    ),
    "edge_tables": (
        edge_tables,
        f"""WITH {DEFINITION}, lx AS (SELECT DISTINCT w FROM bp), ed AS (SELECT DISTINCT right(w, 1) AS base, CASE WHEN length(w) > 1 THEN substr(w, length(w) - 1, 1) END AS inner_ FROM lx), ci AS (SELECT base AS o FROM df WHERE l IS NULL),
want AS (SELECT base, inner_, o AS context, inner_ AS l, o AS r, 'e' AS pos FROM ed, ci WHERE inner_ IS NOT NULL UNION ALL SELECT base, NULL, a.o || ' ' || b.o, a.o, b.o, 's' FROM ed, ci a, ci b WHERE inner_ IS NULL), {NEAREST},
g AS (SELECT found.base, inner_, context, state FROM found JOIN st USING (id)), h AS (SELECT *, min(context) OVER (PARTITION BY base, inner_, state) AS first_ FROM g), p AS (SELECT *, dense_rank() OVER (PARTITION BY base, inner_ ORDER BY first_) - 1 AS place FROM h),
s AS (SELECT base, inner_, string_agg(state, ' ' ORDER BY place) AS first_states, count(*) AS n FROM (SELECT DISTINCT base, inner_, state, place FROM p) GROUP BY ALL)
SELECT s.base, coalesce(s.inner_, '-') AS inner, CAST(s.n AS INTEGER) AS n, first_states, CAST(count(*) AS INTEGER) AS contexts, list_reduce(list_prepend(0::BIGINT, list(place::BIGINT ORDER BY context)), lambda a, x: a * 31 % 1000003 + x) AS places
FROM s JOIN p ON p.base = s.base AND p.inner_ IS NOT DISTINCT FROM s.inner_ GROUP BY s.base, s.inner_, s.n, first_states""",
    ),
}
