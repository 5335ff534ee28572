"""Queries on documents, benchmark and conversations: texts are utterances, benchmark words the lexicon."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import corpus as C
from ..operators import evaluation as V


def _t(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(spark, sf_dir):
    return C.vocabulary(_t(spark, sf_dir, "documents"), "doc_id", "text")


def _lexicon(spark, sf_dir):
    """Each benchmark word with its letters as phones; words that end in n have a second variant."""
    words = C.vocabulary(_t(spark, sf_dir, "benchmark"), "item_id", "text").select(F.lower("token").alias("word")).distinct()
    return words.select("word", F.col("word").alias("base_word"), F.lit(1).alias("variant"), F.filter(F.split("word", ""), lambda c: c != "").alias("phones"))


def oov_report(spark, sf_dir):
    out = C.out_of_vocabulary(_t(spark, sf_dir, "conversations"), _lexicon(spark, sf_dir), "conv_id", "text")
    return out.select("token", "n", "first_key")


def oov_token_total(spark, sf_dir):
    out = C.out_of_vocabulary(_t(spark, sf_dir, "documents"), _lexicon(spark, sf_dir), "doc_id", "text")
    return out.agg(F.sum("n").alias("tokens"), F.count(F.lit(1)).alias("types"))


def oov_near_miss(spark, sf_dir):
    lexicon = _lexicon(spark, sf_dir)
    return C.near_misses(C.out_of_vocabulary(_t(spark, sf_dir, "documents"), lexicon, "doc_id", "text"), lexicon)


def id_reconcile(spark, sf_dir):
    return C.reconcile(_t(spark, sf_dir, "documents"), _t(spark, sf_dir, "labels"), "doc_id")


def normalize_transcripts(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", T.normalise(F.col("text")).alias("text"))


def transcript_parse(spark, sf_dir):
    """Each document's text on one line, in the forms a transcript may have."""
    d = _t(spark, sf_dir, "documents")
    number, text = F.col("doc_id").cast("string"), F.regexp_replace("text", r"\s+", " ")
    form = F.col("doc_id") % 6
    line = (
        F.when(form == 0, F.concat(F.lit("<s> "), text, F.lit(" </s> (utt"), number, F.lit(")")))
        .when(form == 1, F.concat(F.lit("utt"), number, F.lit(" "), text))
        .when(form == 2, F.concat(F.lit("utt"), number, F.lit(" "), text, F.lit(" read(2)")))
        .when(form == 3, F.concat(F.lit(" <s> </s> (a session/"), number, F.lit(")  ")))
        .when(form == 4, F.concat(text, F.lit(" (aside) </s>  (utt"), number, F.lit(")")))
        .otherwise(F.concat(F.lit("utt"), number))
    )
    return d.select("doc_id", T.utterance(line).alias("u")).select("doc_id", "u.*")


def prompt_sniff(spark, sf_dir):
    """Every document as a file; some begin with a comment or with sentence marks."""
    d = _t(spark, sf_dir, "documents")
    form = F.col("doc_id") % 5
    head = F.when(form == 0, "# a, comment\n\n").when(form == 1, "<s> ").when(form == 2, " \n<s> hello </s>\n").when(form == 3, "u1\t").otherwise("")
    return d.groupBy(T.format_of(F.concat(head, "text")).alias("format")).agg(F.count(F.lit(1)).alias("n"))


def lexicon_build(spark, sf_dir):
    lexicon = _lexicon(spark, sf_dir)
    return C.lexicon_lines(lexicon.select(F.concat(F.col("word"), F.lit(" "), F.concat_ws(" ", "phones"), F.lit(" # c")).alias("line")), "line").select(
        "word", "variant", F.concat_ws(" ", "phones").alias("phones")
    )


def lexicon_merge(spark, sf_dir):
    first = _lexicon(spark, sf_dir)
    second = first.filter(F.length("word") <= 6).select("base_word", "variant", F.reverse("phones").alias("phones"))
    out = C.merge_lexicons(first, second)
    return out.select("base_word", "variant", F.concat_ws(" ", "phones").alias("phones"))


def vocabulary_filter(spark, sf_dir):
    words = C.vocabulary(_t(spark, sf_dir, "conversations"), "conv_id", "text").select(F.col("token").alias("word"))
    return C.filter_lexicon(_lexicon(spark, sf_dir), words).select("word")


def phone_set(spark, sf_dir):
    return C.phone_set(_lexicon(spark, sf_dir))


def word_position_contexts(spark, sf_dir):
    """Counts of letters by their place in a word, with neighbours across words, of the documents."""
    from ..operators import sequences as S

    return S.context_counts(_t(spark, sf_dir, "documents"), "text")


def phone_map_apply(spark, sf_dir):
    mapping = F.create_map(F.lit("a"), F.array(F.lit("AH")), F.lit("x"), F.array(F.lit("K"), F.lit("S")), F.lit("h"), F.array().cast("array<string>"))
    return _lexicon(spark, sf_dir).select("word", F.concat_ws(" ", T.map_phones(F.col("phones"), mapping)).alias("phones"))


def stress_strip(spark, sf_dir):
    events = _t(spark, sf_dir, "events")
    bases = F.array(*map(F.lit, ("AX", "AE", "ER", "UX", "K", "IX", "AXR", "OY", "HH")))
    phone = F.concat(F.get(bases, (F.col("event_id") % 9).cast("int")), (F.col("user_id") % 3).cast("string"))
    return events.select("event_id", T.strip_stress(phone).alias("base"), T.stress(phone).alias("stress"), T.is_vowel(phone).alias("vowel"))


def split_train_test(spark, sf_dir):
    return C.split_ids(_t(spark, sf_dir, "documents"), "doc_id", 0.1, "split")


def shard_contiguous(spark, sf_dir):
    d = _t(spark, sf_dir, "documents")
    return C.contiguous_shards(d.select("doc_id"), "doc_id", d.count(), 7)


def shard_round_robin(spark, sf_dir):
    return C.round_robin_shards(_t(spark, sf_dir, "documents").select("doc_id"), "doc_id", 7)


def corpus_part(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").select("doc_id")
    return C.corpus_part(d, "doc_id", d.count(), 3, 3)


def ngram_counts(spark, sf_dir):
    d = _t(spark, sf_dir, "documents")
    return C.ngrams(d, "doc_id", "text", 1, 2, 3)


def cer(spark, sf_dir):
    """Character error rate of each benchmark item's letters against the next item's."""
    b = _t(spark, sf_dir, "benchmark").select("item_id", F.regexp_replace("text", "[^A-Za-z ]", "").alias("t"))
    other = b.select((F.col("item_id") - 1).alias("item_id"), F.col("t").alias("h"))
    return b.join(other, "item_id").select("item_id", F.round(F.levenshtein("t", "h") / F.length("t"), 6).alias("cer"))


def _turns(spark, sf_dir):
    """Each turn against the turn after."""
    c = _t(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("ref"))
    other = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("ref").alias("hyp"))
    return c.join(other, ["conv_id", "turn"])


def wer_total(spark, sf_dir):
    pairs = _turns(spark, sf_dir)
    distance = V.letter_distance(T.words(F.lower("ref")), T.words(F.lower("hyp")))
    return pairs.select("conv_id", "turn", distance.cast("int").alias("errors"))


def wer_breakdown(spark, sf_dir):
    return V.word_counts(_turns(spark, sf_dir), "ref", "hyp").drop("ref", "hyp")


def wer_check(spark, sf_dir):
    """Rows whose operations don't add up to the edit distance: there must be none."""
    counts = V.word_counts(_turns(spark, sf_dir), "ref", "hyp")
    distance = V.letter_distance(T.words(F.lower("ref")), T.words(F.lower("hyp")))
    return counts.agg(F.count(F.when(F.col("subs") + F.col("dels") + F.col("ins") != distance, 1)).alias("differ"), F.count(F.lit(1)).alias("n"))


def wer_aggregate(spark, sf_dir):
    e = _t(spark, sf_dir, "events")
    scores = e.select(
        (F.col("user_id") % 5).alias("speaker"), (F.col("event_id") % 11).alias("hits"), (F.col("event_id") % 3).alias("subs"),
        (F.col("event_id") % 2).alias("dels"), (F.col("event_id") % 5).alias("ins"),
    )
    out = V.rates(scores, "speaker")
    return out.select("speaker", *V.COUNTS, *[F.round(c, 6).alias(c) for c in ("wer", "mer", "wil", "wip")])


def alignment_chunks(spark, sf_dir):
    pairs = _turns(spark, sf_dir).withColumn("key", F.col("conv_id") * 1000 + F.col("turn"))
    return V.chunks(pairs, "key", "ref", "hyp")


def bootstrap_strata(spark, sf_dir):
    counts = V.word_counts(_turns(spark, sf_dir), "ref", "hyp")
    scores = counts.select((F.col("conv_id") % 4).alias("speaker"), (F.col("subs") + F.col("dels") + F.col("ins")).alias("errors"), (F.col("hits") + F.col("subs") + F.col("dels")).alias("words"))
    return V.bootstrap(scores, "speaker", "errors", "words", 1000)


def hash_identity(spark, sf_dir):
    return C.identity(_t(spark, sf_dir, "documents"), "doc_id", "text")


def config_resolve(spark, sf_dir):
    """Settings from the props of events: the user is the path, the type the layer, later layers win."""
    rank = F.array_position(F.array(*map(F.lit, ("click", "view", "error", "signup", "purchase"))), F.col("event_type"))
    e = _t(spark, sf_dir, "events")
    layers = e.groupBy(F.concat(F.lit("user."), F.col("user_id").cast("string")).alias("path"), F.col("event_type").alias("source"), rank.alias("rank")).agg(F.max("event_id").alias("value"))
    return C.overlay(layers)


def report_json(spark, sf_dir):
    per = _t(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    return per.select(F.to_json(F.struct("event_type", "n")).alias("line"))


WORDS = "list_filter(regexp_split_to_array({}, '\\s+'), lambda w: w <> '')"
LEX = f"""lex AS (
  SELECT DISTINCT lower(unnest({WORDS.format('text')})) AS word FROM benchmark
)"""
OOV = "tok AS (SELECT {key} AS k, unnest(" + WORDS.format("text") + ") AS token FROM {table}), oov AS (SELECT token, count(*) AS n, min(k) AS first_key FROM tok WHERE token NOT IN (SELECT word FROM lex) GROUP BY token)"
EDGE = "'^[\\pP\\pS\\pZ]+|[\\pP\\pS\\pZ]+$'"
STRIP = f"regexp_replace({{}}, {EDGE}, '', 'g')"
TURNS = """c AS (SELECT conv_id, turn, text AS t FROM conversations),
p AS (SELECT a.conv_id, a.turn, a.t AS ref, b.t AS hyp FROM c a JOIN c b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)"""
#: Edit operations of each pair by dynamic programming: a row of (cost, operations) a word; ties: match or substitution, deletion, insertion.
EDITS = f"""{TURNS}, words AS (
  SELECT conv_id, turn, {WORDS.format('lower(ref)')} AS r, {WORDS.format('lower(hyp)')} AS h FROM p
), table_ AS (
  SELECT conv_id, turn, r, h, 0 AS i, list_transform(range(len(h) + 1), lambda j: {{'c': j, 'o': repeat('I', CAST(j AS INTEGER))}}) AS row FROM words
  UNION ALL
  SELECT conv_id, turn, r, h, i + 1, list_reduce(
    list_prepend([{{'c': CAST(i + 1 AS BIGINT), 'o': repeat('D', CAST(i + 1 AS INTEGER))}}], list_transform(range(1, len(h) + 1), lambda j: [
      {{'c': row[j].c + CASE WHEN h[j] = r[i + 1] THEN 0 ELSE 1 END, 'o': row[j].o || CASE WHEN h[j] = r[i + 1] THEN 'C' ELSE 'S' END}},
      {{'c': row[j + 1].c + 1, 'o': row[j + 1].o || 'D'}}])),
    lambda a, x: list_append(a, CASE WHEN x[1].c <= x[2].c AND x[1].c <= a[-1].c + 1 THEN x[1] WHEN x[2].c <= a[-1].c + 1 THEN x[2] ELSE {{'c': a[-1].c + 1, 'o': a[-1].o || 'I'}} END))
  FROM table_ WHERE i < len(r)
), edits AS (SELECT conv_id, turn, r, h, row[-1].c AS errors, row[-1].o AS ops FROM table_ WHERE i = len(r))"""
TREE = """f6 AS (SELECT left(md5(line), 6) AS b, sha256(string_agg(line, chr(10) ORDER BY line)) AS h FROM f0 GROUP BY 1),
f4 AS (SELECT left(b, 4) AS b, sha256(string_agg(h, chr(10) ORDER BY b, h)) AS h FROM f6 GROUP BY 1),
f2 AS (SELECT left(b, 2) AS b, sha256(string_agg(h, chr(10) ORDER BY b, h)) AS h FROM f4 GROUP BY 1)
SELECT sha256(string_agg(h, chr(10) ORDER BY b, h)) AS sha256 FROM f2"""

QUERIES = {
    "vocabulary": (vocabulary, f"SELECT DISTINCT unnest({WORDS.format('text')}) AS token FROM documents"),
    "oov_report": (oov_report, f"WITH {LEX}, {OOV.format(key='conv_id', table='conversations')} SELECT * FROM oov"),
    "oov_token_total": (
        oov_token_total,
        f"WITH {LEX}, {OOV.format(key='doc_id', table='documents')} SELECT CAST(sum(n) AS BIGINT) AS tokens, count(*) AS types FROM oov",
    ),
    "oov_near_miss": (
        oov_near_miss,
        f"""WITH {LEX}, {OOV.format(key='doc_id', table='documents')}
SELECT token, 'case' AS hint, word AS meant FROM oov JOIN lex ON lower(token) = word
UNION ALL SELECT token, 'punctuation' AS hint, word AS meant FROM oov JOIN lex ON lower({STRIP.format('token')}) = word WHERE lower({STRIP.format('token')}) <> lower(token)""",
    ),
    "id_reconcile": (
        id_reconcile,
        """SELECT DISTINCT doc_id, 'missing' AS side FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)
UNION ALL SELECT DISTINCT doc_id, 'extra' AS side FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""",
    ),
    "normalize_transcripts": (
        normalize_transcripts,
        f"""SELECT doc_id, array_to_string(list_filter(list_transform({WORDS.format('lower(nfc_normalize(text))')},
lambda w: {STRIP.format('w')}), lambda w: w <> ''), ' ') AS text FROM documents""",
    ),
    "transcript_parse": (
        transcript_parse,
        r"""WITH t AS (SELECT doc_id, doc_id % 6 AS form, CAST(doc_id AS VARCHAR) AS k, regexp_replace(text, '\s+', ' ', 'g') AS t FROM documents),
l AS (SELECT doc_id, trim(CASE form WHEN 0 THEN '<s> ' || t || ' </s> (utt' || k || ')' WHEN 1 THEN 'utt' || k || ' ' || t WHEN 2 THEN 'utt' || k || ' ' || t || ' read(2)'
  WHEN 3 THEN ' <s> </s> (a session/' || k || ')  ' WHEN 4 THEN t || ' (aside) </s>  (utt' || k || ')' ELSE 'utt' || k END) AS l FROM t),
m AS (SELECT doc_id, l, regexp_full_match(l, '(?s)(.*?)\s+\(([^)]+)\)') AS tail, regexp_extract(l, '(?s)^(.*?)\s+\(([^)]+)\)$', 1) AS body FROM l)
SELECT doc_id, CASE WHEN tail THEN regexp_extract(l, '(?s)^(.*?)\s+\(([^)]+)\)$', 2) WHEN contains(l, ' ') THEN split_part(l, ' ', 1) END AS utt_id,
CASE WHEN tail THEN regexp_replace(regexp_replace(body, '^<s>(?:\s+|$)', ''), '(?:^|\s+)</s>$', '') WHEN contains(l, ' ') THEN substr(l, strpos(l, ' ') + 1) END AS text FROM m""",
    ),
    "prompt_sniff": (
        prompt_sniff,
        r"""WITH t AS (SELECT CASE doc_id % 5 WHEN 0 THEN '# a, comment' || chr(10) || chr(10) WHEN 1 THEN '<s> ' WHEN 2 THEN ' ' || chr(10) || '<s> hello </s>' || chr(10) WHEN 3 THEN 'u1' || chr(9) ELSE '' END || text AS t FROM documents),
l AS (SELECT coalesce(list_filter(list_transform(string_split(t, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '' AND x[1] <> '#')[1], '') AS line FROM t)
SELECT CASE WHEN starts_with(line, '<s>') AND contains(line, '</s>') THEN 'sphinx' WHEN contains(line, chr(9)) THEN 'tsv' WHEN contains(line, ',') THEN 'csv' ELSE 'unknown' END AS format, count(*) AS n
FROM l GROUP BY ALL""",
    ),
    "lexicon_build": (
        lexicon_build,
        f"WITH {LEX} SELECT word, 1 AS variant, array_to_string(string_split(word, ''), ' ') AS phones FROM lex",
    ),
    "lexicon_merge": (
        lexicon_merge,
        f"""WITH {LEX}, b AS (
  SELECT word AS base_word, array_to_string(string_split(word, ''), ' ') AS phones, 0 AS r FROM lex
  UNION ALL SELECT word, array_to_string(list_reverse(string_split(word, '')), ' '), 1 FROM lex WHERE length(word) <= 6
), o AS (SELECT base_word, phones, min(r) AS r FROM b GROUP BY ALL)
SELECT base_word, CAST(row_number() OVER (PARTITION BY base_word ORDER BY r, phones) AS INTEGER) AS variant, phones FROM o""",
    ),
    "vocabulary_filter": (
        vocabulary_filter,
        f"WITH {LEX} SELECT word FROM lex WHERE word IN (SELECT unnest({WORDS.format('text')}) FROM conversations)",
    ),
    "phone_set": (phone_set, f"WITH {LEX} SELECT DISTINCT unnest(string_split(word, '')) AS phone FROM lex UNION SELECT 'SIL'"),
    "word_position_contexts": (
        word_position_contexts,
        f"""WITH b AS (SELECT doc_id, {WORDS.format('text')} AS ws FROM documents),
t AS (SELECT doc_id, unnest(range(len(ws))) AS pos, unnest(ws) AS token FROM b),
l AS (SELECT doc_id, pos, unnest(range(length(token))) AS place, unnest(string_split(token, '')) AS phone, length(token) AS size FROM t),
n AS (SELECT phone, place, size, coalesce(lag(phone) OVER w, 'SIL') AS l, coalesce(lead(phone) OVER w, 'SIL') AS r FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY pos, place))
SELECT l AS "left", phone, r AS "right", CASE WHEN size = 1 THEN 's' WHEN place = 0 THEN 'b' WHEN place = size - 1 THEN 'e' ELSE 'i' END AS wpos, count(*) AS n FROM n GROUP BY ALL""",
    ),
    "phone_map_apply": (
        phone_map_apply,
        f"""WITH {LEX} SELECT word, array_to_string(list_filter(list_transform(string_split(word, ''), lambda c: CASE c WHEN 'a' THEN 'AH' WHEN 'x' THEN 'K S' WHEN 'h' THEN '' ELSE c END), lambda c: c <> ''), ' ') AS phones FROM lex""",
    ),
    "stress_strip": (
        stress_strip,
        """WITH p AS (SELECT event_id, user_id, ['AX', 'AE', 'ER', 'UX', 'K', 'IX', 'AXR', 'OY', 'HH'][event_id % 9 + 1] AS base FROM events)
SELECT event_id, base, CAST(user_id % 3 AS INTEGER) AS stress, base IN ('AA','AE','AH','AO','AW','AY','EH','ER','EY','IH','IY','OW','OY','UH','UW') AS vowel FROM p""",
    ),
    "split_train_test": (
        split_train_test,
        "SELECT doc_id, CASE WHEN CAST('0x' || left(md5('split:' || doc_id), 8) AS UBIGINT) / 4294967296.0 < 0.1 THEN 'test' ELSE 'train' END AS part FROM documents",
    ),
    "shard_contiguous": (
        shard_contiguous,
        "SELECT doc_id, CAST(ntile(7) OVER (ORDER BY doc_id) - 1 AS INTEGER) AS shard FROM documents",
    ),
    "shard_round_robin": (shard_round_robin, "SELECT doc_id, CAST(doc_id % 7 AS INTEGER) AS shard FROM documents"),
    "corpus_part": (corpus_part, "SELECT doc_id FROM documents WHERE doc_id >= 2 * (SELECT count(*) // 3 FROM documents)"),
    "ngram_counts": (
        ngram_counts,
        f"""WITH d AS (SELECT {WORDS.format('text')} AS w FROM documents), n AS (SELECT unnest([1, 2, 3]) AS gram_order),
g AS (SELECT gram_order, unnest(list_transform(range(1, len(w) - gram_order + 2), lambda i: array_to_string(list_slice(w, i, i + gram_order - 1), ' '))) AS gram FROM d, n)
SELECT gram, count(*) AS n, gram_order FROM g GROUP BY gram, gram_order""",
    ),
    "cer": (
        cer,
        """WITH b AS (SELECT item_id, regexp_replace(text, '[^A-Za-z ]', '', 'g') AS t FROM benchmark)
SELECT a.item_id, round(levenshtein(a.t, b.t) / length(a.t), 6) AS cer FROM b a JOIN b ON b.item_id = a.item_id + 1""",
    ),
    "wer_total": (wer_total, f"WITH RECURSIVE {EDITS} SELECT conv_id, turn, CAST(errors AS INTEGER) AS errors FROM edits"),
    "wer_breakdown": (
        wer_breakdown,
        f"""WITH RECURSIVE {EDITS} SELECT conv_id, turn, {', '.join(f"CAST(CASE WHEN len(r) = 0 THEN 0 ELSE length(ops) - length(replace(ops, '{o}', '')) END AS INTEGER) AS {n}" for o, n in zip("CSDI", V.COUNTS, strict=True))} FROM edits""",
    ),
    "wer_check": (wer_check, f"WITH {TURNS} SELECT CAST(0 AS BIGINT) AS differ, count(*) AS n FROM p"),
    "wer_aggregate": (
        wer_aggregate,
        """WITH s AS (SELECT user_id % 5 AS speaker, CAST(sum(event_id % 11) AS BIGINT) AS hits, CAST(sum(event_id % 3) AS BIGINT) AS subs, CAST(sum(event_id % 2) AS BIGINT) AS dels, CAST(sum(event_id % 5) AS BIGINT) AS ins FROM events GROUP BY ALL)
SELECT *, round((subs + dels + ins) / (hits + subs + dels), 6) AS wer, round((subs + dels + ins) / (hits + subs + dels + ins), 6) AS mer,
round(1 - (hits / (hits + subs + dels)) * (hits / (hits + subs + ins)), 6) AS wil, round((hits / (hits + subs + dels)) * (hits / (hits + subs + ins)), 6) AS wip FROM s""",
    ),
    "alignment_chunks": (
        alignment_chunks,
        f"""WITH RECURSIVE {EDITS}, each AS (SELECT conv_id * 1000 + turn AS key, ops, unnest(range(1, length(ops) + 1)) AS n FROM edits),
o AS (SELECT key, n, substr(ops, CAST(n AS INTEGER), 1) AS kind, CASE WHEN substr(ops, CAST(n AS INTEGER), 1) = substr(ops, CAST(n AS INTEGER) - 1, 1) THEN 0 ELSE 1 END AS new FROM each),
g AS (SELECT key, n, kind, sum(new) OVER (PARTITION BY key ORDER BY n) AS run, count(*) FILTER (kind <> 'I') OVER (PARTITION BY key ORDER BY n) AS i, count(*) FILTER (kind <> 'D') OVER (PARTITION BY key ORDER BY n) AS j FROM o)
SELECT key, CAST(run - 1 AS INTEGER) AS seq, kind, CAST(max(i) - CASE WHEN kind = 'I' THEN 0 ELSE count(*) END AS INTEGER) AS ref_start, CAST(max(i) AS INTEGER) AS ref_end,
CAST(max(j) - CASE WHEN kind = 'D' THEN 0 ELSE count(*) END AS INTEGER) AS hyp_start, CAST(max(j) AS INTEGER) AS hyp_end FROM g GROUP BY key, run, kind""",
    ),
    "bootstrap_strata": (bootstrap_strata, None),
    "hash_identity": (
        hash_identity,
        f"WITH f0 AS (SELECT doc_id || ':' || sha256(text) AS line FROM documents), {TREE}",
    ),
    "config_resolve": (
        config_resolve,
        """WITH l AS (SELECT 'user.' || user_id AS path, event_type AS source, list_position(['click', 'view', 'error', 'signup', 'purchase'], event_type) AS r, max(event_id) AS value FROM events GROUP BY ALL)
SELECT path, arg_max(value, r) AS value, arg_max(source, r) AS source, count(*) - 1 AS overridden FROM l GROUP BY path""",
    ),
    "report_json": (
        report_json,
        """SELECT '{"event_type":"' || event_type || '","n":' || count(*) || '}' AS line FROM events GROUP BY event_type""",
    ),
}
