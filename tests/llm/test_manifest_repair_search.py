import hashlib
import itertools
import random
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cadenza.llm import hash_search, merkle, turn_repair

DOCS = "doc_id long, source string, lang string, n_chars long, text string, digest string, tree int"
TURNS = "conv_id long, turn long, role string, text string, part string, at int"
VECTORS = "vec_id long, embedding array<double>, dim string, no int"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def duck(sql, name, columns, rows):
    with duckdb.connect() as con:
        con.register(name, pa.table({c: pa.array([r[i] for r in rows], kind) for i, (c, kind) in enumerate(columns)}))
        result = con.sql(sql)
        return [dict(zip(result.columns, r, strict=True)) for r in result.fetchall()]


def plain_levels(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + 2])) for i in range(0, len(levels[-1]), 2)])
    return levels


def plain_manifest(rows):
    def leaf(r, more=0):
        values = (r[0], r[1], r[2], None if r[3] is None else r[3] + more, r[4])
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))

    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    own = {x: sorted((r for r in rows if r[2] == x), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for x in langs}
    trees = {x: plain_levels([leaf(r) for r in own[x]]) for x in langs}
    top = plain_levels([trees[x][-1][0] for x in langs])
    out = []
    for k, x in enumerate(langs):
        for i, r in enumerate(own[x]):
            path = []
            for levels, at in ((trees[x], i), (top, k)):
                for level in levels[:-1]:
                    path.append((level[at ^ 1] if at ^ 1 < len(level) else None, at % 2))
                    at //= 2
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            now = leaf(r, 1 if hit else 0)
            for other, right in path:
                now = sha(now) if other is None else sha(other + now if right else now + other)
            root = top[-1][0]
            out.append((r[0], leaf(r), trees[x][-1][0], root, sha("".join(o for o, _ in path if o)), now, now == root))
    return out


def manifest_rows():
    rng = random.Random(3)
    rows = []
    for n in range(90):
        lang = rng.choice(["en", "en", "en", "é", "z", None, "Z"])
        rows.append((n * 7 % 1000, rng.choice(["a", None, ""]), lang, rng.choice([None, n, -1]), rng.choice(["", None, "x" * 5000, "日本 é\n", f"t{n}"])))
    rows += [(5, "a", "en", 3, "same")] * 3 + [(5, "a", "en", 4, "other"), (None, None, None, None, None), (None, "s", "only", 1, "t"), (-14, "b", "en", 9, "n")]
    return rows


@pytest.mark.parametrize("bits, top", [(12, 1 << 14), (2, 8), (1, 3), (3, 1)])
def test_merkle_against_plain_trees(spark, bits, top):
    rows = manifest_rows()
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], DOCS)
    got = merkle.manifest(docs, bits, top).collect()
    assert sorted(map(tuple, got), key=str) == sorted(plain_manifest(rows), key=str)
    assert 0 < sum(r["verified"] for r in got) < len(got)


def test_merkle_sql_and_edges(spark):
    rows = manifest_rows()
    kinds = [("doc_id", pa.int64()), ("source", pa.string()), ("lang", pa.string()), ("n_chars", pa.int64()), ("text", pa.string())]
    found = [tuple(r.values()) for r in duck(merkle.SQL, "documents", kinds, rows)]
    assert sorted(found, key=str) == sorted(plain_manifest(rows), key=str)
    empty = merkle.manifest(spark.createDataFrame([], DOCS))
    assert empty.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"] and empty.count() == 0
    alone = merkle.manifest(spark.createDataFrame([(1, None, "en", 2, "t", "", 0)], DOCS)).first()
    assert alone["leaf"] == alone["subroot"] == alone["root"] and alone["proof_sha256"] == sha("") and alone["verified"]
    proof = merkle._siblings(merkle._levels([sha(str(n)) for n in range(11)], 4), 9)
    assert merkle.fold(sha("9"), proof) == plain_levels([sha(str(n)) for n in range(11)])[-1][0]


# --- conversations -----------------------------------------------------------------------------------

SPACE = " \t\n\v\f\r"


def plain_turns(rows):
    """conv_id to its turns (turn, role, text, fault) after damage."""
    out = {r[0]: [] for r in rows}
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        what = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if what == 1:
            text = ""
        elif what == 2:
            text = "".join(c for c in text if c not in ".!?")
        elif what == 4:
            role = "user"
        out[conv] += [(turn, role, text)] * (0 if what == 0 else 2 if what == 3 else 1)
    for conv, turns in out.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1], t[2]))
        seen, marked = set(), []
        for turn, role, text in turns:
            bare = text.strip(SPACE)
            fault = 1 if not bare else 2 if (role, text) in seen else 3 if bare[-1] not in ".!?" else 0
            seen.add((role, text))
            marked.append((turn, role, text, fault))
        out[conv] = marked
    return out


def plain_repair(turns):
    """cost, audit and lines by trying every string of edits, with up to two insertions in each gap: two turns lead from any state to any."""
    best = None
    for edits in itertools.product("DKR", repeat=len(turns)):
        for gaps in itertools.product(range(3), repeat=len(turns) + 1):
            audit = "".join("I" * g + e for g, e in zip(gaps, edits, strict=False)) + "I" * gaps[-1]
            cost, lines, i, state = 0, [], 0, "start"
            for label in audit:
                if label == "I":
                    initial, line, price = ("a", "assistant:", 3) if state == "u" else ("u", "user:", 3)
                else:
                    _, role, text, fault = turns[i]
                    i += 1
                    if label == "D":
                        cost += 4
                        continue
                    if fault in (1, 2):
                        break
                    price = 3 if fault == 3 else 0
                    initial = role[:1]
                    if label == "R":
                        role = "assistant" if state == "u" else "user"
                        initial, price = role[0], price + 3
                    line = f"{role}:{text}"
                if initial not in {"start": "su", "s": "u", "u": "a", "a": "u"}[state]:
                    break
                if not initial:
                    break
                state, cost = initial, cost + price
                lines.append(line)
            else:
                if state in ("start", "a") and (best is None or (cost, audit) < best[:2]):
                    best = (cost, audit, "\n".join(lines))
    return best


def plain_rows(rows):
    out = []
    for conv, turns in plain_turns(rows).items():
        numbers = [t[0] for t in turns if t[0] is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:], strict=False))
        cost, audit, text = plain_repair(turns)
        out.append((conv, gaps, *(sum(t[3] == f for t in turns) for f in (1, 2, 3)), illegal, cost, audit, sha(text)))
    return out


def conversation_rows(count, longest, seed=5):
    rng = random.Random(seed)
    roles, texts = ["user", "assistant", "user", "assistant", "system", None, "", "tool"], ["Hi.", "Ok", "", "  \n", "b!", None, "é?", "z. ", "q.\x0b"]
    rows = []
    for conv in range(count):
        rows += [(conv or None, rng.choice([t, t, t * 2, None]), rng.choice(roles), rng.choice(texts)) for t in range(rng.randrange(1, longest))]
    return rows


def test_repair_against_every_string_of_edits(spark):
    rows = conversation_rows(50, 4)
    want = sorted(plain_rows(rows), key=str)
    frame = spark.createDataFrame([(*r, "clash", 0) for r in rows], TURNS).repartition(3)
    for part_bits in (12, 1):
        assert sorted((tuple(r) for r in turn_repair.repair(frame, part_bits).collect()), key=str) == want


@pytest.mark.parametrize("part_bits", [12, 2])
def test_repair_against_sql(spark, part_bits):
    rows = conversation_rows(40, 14, 6) + [(99, t, "user" if t % 3 else "assistant", f"{t}.") for t in range(300)]
    kinds = [("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())]
    want = duck(turn_repair.SQL, "conversations", kinds, rows)
    got = [r.asDict() for r in turn_repair.repair(spark.createDataFrame([(*r, "", 0) for r in rows], TURNS).repartition(5), part_bits).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_repair_edges(spark):
    assert turn_repair.repair(spark.createDataFrame([], TURNS)).count() == 0
    dropped = next(n for n in range(1000) if zlib.crc32(f"{n}:0".encode()) % 20 == 0)
    plain = next(n for n in range(1000) if zlib.crc32(f"{n}:0".encode()) % 20 > 4 and zlib.crc32(f"{n}:1".encode()) % 20 > 4)
    long = "x" * 200_000 + "."
    rows = [(dropped, 0, "user", "Hi."), (plain, 0, "user", long), (plain, 1, "assistant", "Yes.")]
    got = {r["conv_id"]: r for r in turn_repair.repair(spark.createDataFrame([(*r, "", 0) for r in rows], TURNS)).collect()}
    assert tuple(got[dropped])[1:] == (0, 0, 0, 0, 0, 0, "", sha(""))
    assert tuple(got[plain])[1:] == (0, 0, 0, 0, 0, 0, "KK", sha(f"user:{long}\nassistant:Yes."))


# --- nearest neighbours ------------------------------------------------------------------------------


def plain_nearest(vectors, k, every):
    out = {}
    for n, (i, v) in enumerate(vectors):
        if i % every == 0:
            score = [(-float(np.dot(v, w) / (np.linalg.norm(v) * np.linalg.norm(w))), j) for m, (j, w) in enumerate(vectors) if m != n and len(w) == len(v)]
            out.setdefault(i, []).append([j for _, j in sorted((round(s, 12), j) for s, j in score)][:k])
    return out


def test_codes_within_a_radius_are_all_retrieved():
    rng = np.random.default_rng(0)
    codes = rng.integers(0, 1 << 16, size=(3000, 4)).astype("<u2")
    codes[:500] = codes[0] ^ (1 << rng.integers(0, 16, size=(500, 4))).astype("<u2")
    index = hash_search.CodeIndex(codes)
    for radius in (0, 1, 3, 4, 5, 9, 17, 26, 40, 64):
        assert sum(x + 1 for x in hash_search.piece_radii(radius, 4)) == radius + 1
        for q in (0, 7, 2999):
            off = np.bitwise_count(codes ^ codes[q]).sum(axis=1)
            rows, distances = index.within(codes[q], radius)
            assert rows.tolist() == np.flatnonzero(off <= radius).tolist() and distances.tolist() == off[rows].tolist()


def test_learned_codes_keep_angles():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 20)) * np.linspace(3, 0.1, 20)
    projection = hash_search.learned_rotation(x)
    assert np.allclose(projection.T @ projection, np.eye(20))
    codes = hash_search.binary_codes(x, projection)
    near = x + rng.normal(size=x.shape) * 0.05
    off = np.bitwise_count(codes ^ hash_search.binary_codes(near, projection)).sum(axis=1)
    other = np.bitwise_count(codes ^ np.roll(codes, 1, axis=0)).sum(axis=1)
    assert off.mean() < 0.35 * other.mean()


def test_search_finds_the_nearest(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got = {}
    for r in hash_search.neighbours(docs, F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    vectors = [(r["vec_id"], np.array(r["embedding"], dtype=float)) for r in docs.select("vec_id", "embedding").collect()]
    by = dict(vectors)
    want = plain_nearest(vectors, 5, 50)
    hits = sum(len({v for v, _ in got[q].values()} & set(lists[0])) for q, lists in want.items())
    assert hits >= 0.9 * 5 * len(want)
    for q, found in got.items():
        assert sorted(found) == [1, 2, 3, 4, 5]
        for v, score in found.values():
            assert abs(score - by[q] @ by[v] / np.linalg.norm(by[q]) / np.linalg.norm(by[v])) < 1e-12
        assert sorted(found.values(), key=lambda x: (-x[1], x[0])) == [found[n] for n in range(1, 6)]


def test_search_edges(spark, monkeypatch):
    nan, inf = float("nan"), float("inf")
    odd = [(0, None), (50, [0.0, 0.0]), (100, [nan, 1.0]), (150, [inf, 1.0]), (200, [None, 1.0]), (None, [1.0, 2.0]), (250, [])]
    rng = np.random.default_rng(2)
    some = [(n, rng.normal(size=3).tolist()) for n in range(1, 40)]
    ties = [(n, [1.0, 2.0, 3.0]) for n in (300, 301, 299, 350, 350, 351, 352)] + [(400, [1e200, 0.0]), (401, [1e-200, 1e-200]), (450, [5.0])]
    frame = spark.createDataFrame([(i, v, "clash", 1) for i, v in odd + some + ties], VECTORS)
    for shard, block in ((32768, 4096), (7, 1)):
        monkeypatch.setattr(hash_search, "SHARD", shard)
        monkeypatch.setattr(hash_search, "BLOCK", block)
        got = {}
        for r in hash_search.neighbours(frame, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank", "vec_id").collect():
            got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
        assert sorted(got) == [300, 350, 400]
        assert [v for _, v, _ in got[300]] == [299, 301, 350, 350, 351]
        assert sorted(v for _, v, _ in got[350]) == sorted([299, 300, 301, 350, 351] * 2)
        assert [(v, round(s, 6)) for _, v, s in got[400]] == [(401, 0.707107)]
    assert hash_search.neighbours(spark.createDataFrame([], VECTORS), F.col("vec_id") % 50 == 0).count() == 0
    lone = spark.createDataFrame([(50, [1.0], "", 0)], VECTORS)
    assert hash_search.neighbours(lone, F.col("vec_id") % 50 == 0).count() == 0
