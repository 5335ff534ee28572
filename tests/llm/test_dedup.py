"""Exact, near and line dedup against brute force, with nulls, ties, repeats and clashing columns."""

import hashlib
import random
import re

import pytest
import xxhash
from cadenza.llm import exact_dedup, line_dedup, simhash
from cadenza.llm.components import components
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, rep long, kept string, root long"


def frame(spark, texts, schema=SCHEMA):
    """Documents with extra columns whose names clash with internal ones."""
    return spark.createDataFrame([(i, t, "en", "s", None, "x", 1, "y", 2) for i, t in texts], schema)


WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def edited(rng, text):
    words = text.split()
    words[rng.randrange(len(words))] = rng.choice(WORDS)
    return " ".join(words)


def test_exact_dedup_matches_brute_force(spark):
    texts = [(n, "copy") for n in range(40)] + [(40, None), (41, ""), (42, "a"), (43, "A"), (44, "a "), (45, "x" * 100_000), (46, "x" * 100_000)]
    texts += [(None, "a"), (42, "a")]
    rows = exact_dedup.exact_dedup(frame(spark, texts), support=0.1).collect()
    assert len(rows) == len(texts)
    groups = {}
    for i, t in texts:
        groups.setdefault(t or "", []).append(i)
    by = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    for r in rows:
        ids = by[r["text_sha256"]]
        assert r["keep_id"] == max(i for i in ids if i is not None)
        assert r["group_size"] == len(ids)
        assert r["kept"] == (r["doc_id"] == r["keep_id"])


def test_exact_dedup_finds_heavy_hitters(spark):
    docs = frame(spark, [(n, "hot" if n % 3 == 0 else f"t{n}") for n in range(3000)])
    winners = exact_dedup.frequent_winners(exact_dedup.digests(docs), 0.01).collect()
    assert [(w["keep_id"], w["group_size"]) for w in winners] == [(2997, 1000)]


def test_exact_filter_keeps_columns_and_empty_tables(spark):
    docs = frame(spark, [(1, "a"), (2, "a"), (3, None)])
    out = exact_dedup.drop_exact_copies(docs)
    assert out.columns == docs.columns
    assert {r["doc_id"] for r in out.collect()} == {2, 3}
    assert exact_dedup.exact_dedup(docs.limit(0)).count() == 0
    assert exact_dedup.drop_exact_copies(docs.limit(0)).count() == 0


def brute_fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    shingles = [" ".join(words[n : n + 3]) for n in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    parent = {i: i for i, _ in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, (i, a) in enumerate(fps):
        for j, b in fps[n + 1 :]:
            if (a ^ b).bit_count() <= 3:
                p, q = root(i), root(j)
                parent[max(p, q)] = min(p, q)
    return {i: root(i) for i, _ in fps}


@pytest.mark.parametrize("crowd", [4096, 2])
def test_simhash_matches_brute_force(spark, crowd):
    rng = random.Random(9)
    texts = [(n, sentence(rng, rng.choice([0, 1, 2, 3, 5, 40, 200]))) for n in range(60)]
    base = sentence(rng, 120)
    texts += [(100 + n, edited(rng, base)) for n in range(30)] + [(200, None), (201, " \t\n"), (202, base), (203, base), (204, "Ünïcode ÀB  x" * 500)]
    rows = {r["doc_id"]: r for r in simhash.near_groups(frame(spark, texts), crowd).collect()}
    assert len(rows) == len(texts)
    fps = [(i, brute_fingerprint(t)) for i, t in texts]
    want = brute_components(fps)
    for i, fp in fps:
        assert rows[i]["fingerprint"] == f"{fp:016x}"
        assert rows[i]["component_id"] == want[i]


@pytest.mark.parametrize("crowd", [4096, 3])
def test_simhash_links_dense_fingerprints(spark, crowd):
    rng = random.Random(3)
    fps = set()
    for _ in range(12):
        centre = rng.getrandbits(64)
        for _ in range(25):
            flips = sum(1 << b for b in rng.sample(range(64), rng.randrange(0, 5)))
            fps.add(centre ^ flips)
    fps = sorted(fps)
    signed = [(f - (1 << 64) * (f >> 63), n) for n, f in enumerate(fps)]
    groups = spark.createDataFrame(signed, "fp long, rep long")
    got = {r["node"]: r["root"] for r in components(simhash.links(groups, crowd)).collect()}
    want = brute_components([(n, f) for n, f in enumerate(fps)])
    assert {n: got.get(n, n) for n in want} == want


def test_simhash_edges(spark):
    docs = frame(spark, [(5, "a b c d"), (3, "a b c d"), (None, "a b c d"), (None, "lonely words here now")])
    got = sorted(((r["doc_id"], r["component_id"]) for r in simhash.near_groups(docs).collect()), key=str)
    assert got == sorted([(5, 3), (3, 3), (None, 3), (None, None)], key=str)
    assert simhash.near_groups(docs.limit(0)).count() == 0
    kept = simhash.drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["3", "None", "None"]


def test_components_of_chains_loops_and_nulls(spark):
    chain = [(n, n + 1) for n in range(20)] + [(50, 50), (60, 61), (61, 60), (None, 3)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {n: 0 for n in range(21)} | {50: 50, 60: 60, 61: 60}


def shingle_set(line):
    return {line[n : n + 8] for n in range(max(1, len(line) - 7))}


def test_lines_match_brute_force(spark):
    rng = random.Random(7)
    base = [sentence(rng, 30) for _ in range(12)]
    docs = []
    for n in range(60):
        lines = [edited(rng, rng.choice(base)) if rng.random() < 0.6 else sentence(rng, 25) for _ in range(4)]
        docs.append((n, "\n".join([*lines, "", "the same line", "  "])))
    docs += [(70, None), (71, ""), (72, "\n"), (73, "x")]
    rows = line_dedup.line_groups(frame(spark, docs)).collect()
    lines = {(i, k): t for i, text in docs for k, t in enumerate((text or "").split("\n")) if t.strip()}
    assert {(r["doc_id"], r["line_no"]) for r in rows} == set(lines)
    parent = {k: k for k in lines}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = sorted(lines)
    sets = {k: shingle_set(lines[k]) for k in keys}
    linked = 0
    for n, a in enumerate(keys):
        for b in keys[n + 1 :]:
            if lines[a] == lines[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                linked += 1
                p, q = root(a), root(b)
                parent[max(p, q)] = min(p, q)
    got = {(r["doc_id"], r["line_no"]): (r["group_doc_id"], r["group_line_no"]) for r in rows}
    assert linked > 100
    right = sum(got[k] == root(k) for k in keys)
    assert right >= 0.97 * len(keys)
    assert all(r["kept"] == ((r["doc_id"], r["line_no"]) == (r["group_doc_id"], r["group_line_no"])) for r in rows)


def test_bands_meet_in_one_minimum_at_most():
    found = line_dedup.bands(classes=4)
    assert len(found) == 16 and all(len(set(x)) == 4 for x in found)
    assert all(len(set(x) & set(y)) <= 1 for n, x in enumerate(found) for y in found[:n])


@pytest.mark.parametrize("words", [8, 15, 40])
def test_recall_against_all_shingles(spark, words, count=2000):
    """Of pairs whose full shingle sets are just similar, nearly all must meet in a bucket."""
    rng = random.Random(words)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.choice([2, 3, 4, 5, 6, 9, 12])))
    docs, near = [], set()
    for n in range(count):
        line = [word() for _ in range(words)]
        other = list(line)
        for _ in range(rng.randint(1, max(1, words // 12))):
            at = rng.randrange(words)
            other[at] = word()
        a, b = shingle_set(" ".join(line)), shingle_set(" ".join(other))
        docs += [(2 * n, " ".join(line)), (2 * n + 1, " ".join(other))]
        if 0.8 <= len(a & b) / len(a | b) < 0.87:
            near.add(n)
    lines = line_dedup.lines_of(frame(spark, docs))
    signed = line_dedup.signatures(lines).join(lines.select("d1", F.expr("doc_id div 2 AS pair")), "d1")
    met = line_dedup.buckets(signed.withColumnRenamed("lid", "l").withColumnRenamed("pair", "lid")).withColumnRenamed("lid", "pair").groupBy("pair", "bucket").count().filter("count > 1")
    found = {r["pair"] for r in met.select("pair").distinct().collect()}
    print(f"{words} words: {len(near & found)} of {len(near)}")
    assert len(near) > 100 and len(near & found) >= 0.94 * len(near)


def test_pairs_that_no_band_brings_together(spark, monkeypatch):
    """Signatures may miss a pair at the threshold; here they miss all, and every link is found all the same."""
    rng = random.Random(17)
    lines = [" ".join("".join(rng.choices("abcdefghij", k=5)) for _ in range(rng.choice([4, 12, 40]))) for _ in range(60)]
    lines += [w[: len(w) // 2] + "#" * n + w[len(w) // 2 + n :] for w in lines for n in range(3)] + ["short", "short one"]
    lines = list(dict.fromkeys(lines))
    rows = line_dedup.lines_of(frame(spark, list(enumerate(lines))))
    signed = line_dedup.signatures(rows).join(rows.select("d1", "doc_id"), "d1").select("d1", "d2", F.col("doc_id").alias("lid"), "minima")
    monkeypatch.setattr(line_dedup, "buckets", lambda signed: signed.select("lid", F.col("lid").alias("bucket")))
    got = {r["node"]: r["root"] for r in components(line_dedup.connections(rows, signed)).collect()}
    sets = [shingle_set(line) for line in lines]
    links = [(a, b) for a in range(len(sets)) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert len(links) > 40
    assert all(got.get(a, a) == got.get(b, b) for a, b in links)
    roots = list(range(len(lines)))
    for _ in lines:
        for a, b in links:
            roots[a] = roots[b] = min(roots[a], roots[b])
    assert {n: got.get(n, n) for n in range(len(lines))} == dict(enumerate(roots))


@pytest.mark.parametrize("group", [2, 256])
def test_links_by_neighbours_are_whole_and_few_lines_meet(spark, monkeypatch, group):
    """Without bands every similar pair is linked, and lines of the same few words that aren't similar are not compared."""
    rng = random.Random(23)
    words = ["".join(rng.choices("abcdefgh", k=rng.choice([2, 3, 4, 6]))) for _ in range(60)]
    lines = [" ".join(rng.choices(words, k=rng.choice([8, 20, 45]))) for _ in range(150)]
    lines += [" ".join([*x[: len(x) // 2], *rng.choices(words, k=n), *x[len(x) // 2 + n :]]) for x in map(str.split, lines[:40]) for n in (1, 2)]
    lines += [x + " " + " ".join(rng.choices(words, k=1 + len(x) // 40)) for x in lines[:40]] + ["short", "aaaaaaaaa", "aaaaaaaaaaaa"]
    lines = list(dict.fromkeys(lines))
    rows = line_dedup.lines_of(frame(spark, list(enumerate(lines))))
    signed = line_dedup.signatures(rows).join(rows.select("d1", "doc_id"), "d1").select("d1", "d2", F.col("doc_id").alias("lid"), "minima")
    compared, similar = [], line_dedup._similar
    monkeypatch.setattr(line_dedup, "_similar", lambda pairs, *more: compared.append(pairs.select("u", "v").distinct().count()) or similar(pairs, *more))
    monkeypatch.setattr(line_dedup, "buckets", lambda signed: signed.select("lid", F.col("lid").alias("bucket")))
    monkeypatch.setattr(line_dedup, "GROUP", group, raising=False)
    stored, checkpoint = [], line_dedup.checkpoint
    monkeypatch.setattr(line_dedup, "checkpoint", lambda df: stored.extend(df.columns) or checkpoint(df))
    got = {r["node"]: r["root"] for r in components(line_dedup.connections(rows, signed)).collect()}
    sets = [shingle_set(line) for line in lines]
    links = [(a, b) for a in range(len(sets)) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    roots = list(range(len(lines)))
    for _ in lines:
        for a, b in links:
            roots[a] = roots[b] = min(roots[a], roots[b])
    assert len(links) > 40
    assert {n: got.get(n, n) for n in range(len(lines))} == dict(enumerate(roots))
    assert group == 2 or sum(compared) <= 3 * len(links)
    assert "line" not in stored  # texts are not written once more


@pytest.mark.parametrize("full", [3.2, 64])
def test_similar_lines_share_words(spark, monkeypatch, full):
    """Lines at the threshold share more words than _more, whatever differs; parts of 64 shingles leave too few words, so single ones serve."""
    rng = random.Random(29)
    similar = lambda x, y: len(x & y) >= 0.8 * len(x | y)
    near = []
    for size in [8, 9, 12, 15, 20, 30, 50, 80, 120, 200, 300, 500, 900] * 4:
        line = "".join(rng.choices("abcde ", k=size))
        for other in (line, "x" + line[: size // 2]):  # edited all over, or grown at the end only
            while True:
                at = rng.randrange(len(line))
                changed = other[:at] + rng.choice("vwxyz") + other[at + 1 :] if other[0] != "x" else other + rng.choice("vwxyz")
                if not similar(shingle_set(line), shingle_set(changed)) and (other[0] != "x" or len(other) > len(line)):
                    break
                other = changed
            if other != line and similar(shingle_set(line), shingle_set(other)):
                near.append((line, other))
            near.append((line, line + "y" * (len(line) // 9)))
    near = [p for p in near if similar(*map(shingle_set, p))]
    assert len(near) > 60
    monkeypatch.setattr(line_dedup, "FULL", full)
    lines = sorted({x for p in near for x in p})
    number = {x: n for n, x in enumerate(lines)}
    found = {}
    for r in line_dedup._words(spark.createDataFrame(list(enumerate(lines)), "lid long, line string")).collect():
        found.setdefault(r["lid"], []).append((r["h"], r["size"]))
    for n, line in enumerate(lines):
        size = len(shingle_set(line))
        assert {s for _, s in found[n]} == {size}
        assert full > 4 or len(found[n]) <= 2 * 2 * (size // 4 + size // 64 + 1)
    for a, b in near:
        shared = {h for h, _ in found[number[a]]} & {h for h, _ in found[number[b]]}
        assert len(shared) > min(len(shingle_set(a)), len(shingle_set(b))) // 64


def test_lines_of_one_passage_are_not_compared(spark, monkeypatch):
    """Lines of one crowded word that differ in most are ruled out by sketches; similar ones among them are linked."""
    rng = random.Random(31)
    text = lambda n: " ".join("".join(rng.choices("abcdefghijklmnop", k=6)) for _ in range(n))
    passage = text(30)
    lines = [f"{passage} {text(30)}" for _ in range(40)]
    lines += [x[:-6] + "qrstuv" for x in lines[:5]]
    rows = line_dedup.lines_of(frame(spark, list(enumerate(lines))))
    signed = line_dedup.signatures(rows).join(rows.select("d1", "doc_id"), "d1").select("d1", "d2", F.col("doc_id").alias("lid"), "minima")
    compared, similar = [], line_dedup._similar
    monkeypatch.setattr(line_dedup, "_similar", lambda pairs, *more: compared.append(pairs.select("u", "v").distinct().count()) or similar(pairs, *more))
    monkeypatch.setattr(line_dedup, "buckets", lambda signed: signed.select("lid", F.col("lid").alias("bucket")))
    monkeypatch.setattr(line_dedup, "GROUP", 4)
    got = {r["node"]: r["root"] for r in components(line_dedup.connections(rows, signed)).collect()}
    assert {n: got.get(n, n) for n in range(45)} == {n: n % 40 for n in range(45)}
    assert sum(compared) < 200  # of 990 pairs; with heads, before sketches


def test_large_buckets_of_lines(spark):
    rng = random.Random(1)
    base = sentence(rng, 40)
    docs = [(n, edited(rng, base)) for n in range(80)]
    rows = line_dedup.line_groups(frame(spark, docs)).collect()
    assert sum(r["kept"] for r in rows) <= 2


def test_chains_in_a_crowded_shingle(spark, monkeypatch):
    """All lines meet in one bucket: what the rare shingles link must be all that brute force links."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(8))
    base = [word() for _ in range(40)]
    # The last two match each other; the last but one matches the first, too, the last doesn't.
    texts = [base, *[[*base, word()] for _ in range(17)], base[5:], base[10:]]
    # Lines of no match, which make the words that the last two lack frequent.
    texts += [[*base[:10], *[word() for _ in range(30)]] for _ in range(60)]
    lines = line_dedup.lines_of(frame(spark, [(n, " ".join(t)) for n, t in enumerate(texts)]))
    signed = line_dedup.signatures(lines).join(lines.select("d1", "doc_id"), "d1").select("d1", "d2", F.col("doc_id").alias("lid"), "minima")
    monkeypatch.setattr(line_dedup, "buckets", lambda rows: rows.select("lid", F.lit(0).cast("long").alias("bucket")))
    rows = components(line_dedup.connections(lines, signed)).collect()
    got = {n: n for n in range(len(texts))} | {r["node"]: r["root"] for r in rows}
    want = {n: n for n in range(len(texts))}
    sets, changed = [shingle_set(" ".join(t)) for t in texts], True
    near = [(a, b) for b in range(len(sets)) for a in range(b) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in near:
            if want[a] != want[b]:
                want[a] = want[b] = min(want[a], want[b])
                changed = True
    assert len(set(want.values())) < len(texts)
    assert got == want


@pytest.mark.parametrize("copies", [20])
def test_a_chain_of_kinds_in_one_crowd(spark, copies, monkeypatch):
    """A is like B and B like C, but A isn't like C: copies of each must come out as one group."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7))
    a = [word() for _ in range(60)]
    b = a[:56] + [word() for _ in range(4)]
    c = b[:50] + [word() for _ in range(4)] + b[54:]
    kinds = [a, b, c]
    j = lambda x, y: len(shingle_set(" ".join(x)) & shingle_set(" ".join(y))) / len(shingle_set(" ".join(x)) | shingle_set(" ".join(y)))
    assert j(a, b) >= 0.83 and j(b, c) >= 0.83 and j(a, c) < 0.8
    texts = [" ".join(k + [f"{n:02}"]) for n in range(copies) for k in kinds]
    texts += [" ".join(a[:20] + [word() for _ in range(40)]) for _ in range(100)]
    lines = line_dedup.lines_of(frame(spark, list(enumerate(texts))))
    signed = line_dedup.signatures(lines).join(lines.select("d1", "doc_id"), "d1").select("d1", "d2", F.col("doc_id").alias("lid"), "minima")
    monkeypatch.setattr(line_dedup, "buckets", lambda rows: rows.select("lid", F.lit(0).cast("long").alias("bucket")))
    got = {r["node"]: r["root"] for r in components(line_dedup.connections(lines, signed)).collect()}
    assert {got[n] for n in range(3 * copies)} == {0}
    assert all(n not in got for n in range(3 * copies, len(texts)))


def test_lines_of_long_words_are_read_whole(spark):
    khmer = "សេចក្តីប្រកាសជាសកលស្តីពី"
    lines = ["https://a.org/x", "https://b.net/y", "Conclusion", "Conclusions", "data:image/png;base64,AAAA", "data:image/gif;base64,BBBB"]
    lines += ["0123456789abcdef", "01234567ffffffff", khmer + "សិទ្ធិមនុស្ស", khmer + "ច្បាប់អន្តរជាតិទូទៅ", "漢字 https://c.com/p", "漢字 https://d.edu/q"]
    long = "".join(chr(97 + n * n % 26) + str(n) for n in range(60))
    lines += [long, long + "z"]
    rows = line_dedup.line_groups(frame(spark, list(enumerate(lines)))).collect()
    assert {r["doc_id"]: r["group_doc_id"] for r in rows} == {n: n for n in range(len(lines) - 1)} | {len(lines) - 1: len(lines) - 2}


def test_line_ids_and_text(spark):
    docs = frame(spark, [(1, "one two three\n\nkeep me\n"), (2, "keep me\nother line"), (3, None), (-5, "far away"), (1 << 60, "far out\nfar away"), (None, "other line\nkeep me")])
    out = {r["doc_id"]: r["text"] for r in line_dedup.drop_repeated_lines(docs).collect()}
    assert out == {1: "one two three\n\nkeep me\n", 2: "other line", 3: None, -5: "far away", 1 << 60: "far out", None: ""}
    groups = {(r["doc_id"], r["line_no"]): (r["group_doc_id"], r["group_line_no"], r["kept"]) for r in line_dedup.line_groups(docs).collect()}
    assert groups[1 << 60, 0] == (1 << 60, 0, True) and groups[1 << 60, 1] == (-5, 0, False) and groups[None, 1] == (1, 2, False)
    assert line_dedup.line_groups(docs.limit(0)).count() == 0
    assert line_dedup.drop_repeated_lines(docs).columns == docs.columns


def test_lines_of_rows_that_repeat_an_id(spark):
    docs = frame(spark, [(1, "same line here"), (1, "same line here"), (1, "same line here\nlast")])
    rows = line_dedup.line_groups(docs).collect()
    assert len(rows) == 4 and sum(r["kept"] for r in rows) == 2
    assert sorted(len(r["text"]) for r in line_dedup.drop_repeated_lines(docs).collect())[:1] == [0]


def test_no_checkpoint_is_local():
    from pathlib import Path

    for path in Path(line_dedup.__file__).parent.glob("*.py"):
        assert "localCheckpoint" not in path.read_text()
    assert F is not None


def test_pairs_share_what_their_sizes_ask_for(spark, monkeypatch):
    """Lines of one size differ in less than the most that similar lines can, so they must share more words; those that share too few don't meet."""
    rng = random.Random(41)
    text = lambda n: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=n))
    lines = []
    for size in (60, 130, 400, 900):
        for grown in (0, size // 20, size // 9, size // 5):
            x = text(size + 7)
            lines += [x, x[: size // 2] + "#" * max(1, size // 80) + x[size // 2 + max(1, size // 80) :] + text(grown)]
        x = text(size // 2 + 7)
        lines += [x + text(size // 2) for _ in range(4)]  # half in common
    rows = spark.createDataFrame(list(enumerate(lines)), "lid long, line string")
    sets = [shingle_set(x) for x in lines]
    words = {}
    for r in line_dedup._words(rows).collect():
        words.setdefault(r["lid"], set()).add(r["h"])
    need = spark.createDataFrame([(a, b, len(sets[a]), len(sets[b])) for a in range(len(sets)) for b in range(a + 1, len(sets))], "u long, v long, m int, n int")
    need = {(r["u"], r["v"]): r["k"] for r in need.select("u", "v", line_dedup._needed(F.col("m"), F.col("n")).alias("k")).collect()}
    alike = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    similar = {p for p in need if alike(*p)}
    assert len(similar) >= 8 and all(len(words[a] & words[b]) >= need[a, b] for a, b in similar)
    assert need[similar and min(similar)] > min(len(sets[x]) for x in min(similar)) // 64 + 1
    sizes_match = lambda a, b: min(len(sets[a]), len(sets[b])) >= 0.8 * max(len(sets[a]), len(sets[b]))
    want = {(a, b) for (a, b), k in need.items() if sizes_match(a, b) and len(words[a] & words[b]) >= k}
    assert {(r["u"], r["v"]) for r in line_dedup._met(rows).collect()} == want and similar <= want
    sketches = line_dedup._sketches(rows).collect()
    assert {r["lid"]: r["n"] for r in sketches} == {n: len(x) for n, x in enumerate(sets)} and all(len(r["sketch"]) == 8 for r in sketches)
    monkeypatch.setattr(line_dedup, "GROUP", 1)  # every shared word is one of more lines
    crowd = {(r["h"], r["u"]) for r in line_dedup._met(rows).collect()}
    assert crowd == {(h, n) for n in words for h in words[n] if sum(h in w for w in words.values()) > 1}
