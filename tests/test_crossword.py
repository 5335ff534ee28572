"""Triphone lookup and word-edge tables on a small definition."""

from cadenza.operators import crossword

ROWS = [
    (0, "A", None, None, None, [0, 1]), (1, "B", None, None, None, [2, 3]), (2, "SIL", None, None, None, [4, 5]), (3, "+N+", None, None, None, [6, 7]),
    (4, "A", "B", "SIL", "e", [10, 11]), (5, "A", "B", "SIL", "i", [10, 12]), (6, "A", "B", "A", "s", [10, 11]), (7, "A", "B", "B", "e", [13, 11]), (8, "A", "SIL", "SIL", "s", [1, 14]),
]


def definition(spark):
    return spark.createDataFrame(ROWS, "id long, base string, left string, right string, pos string, states array<int>")


def test_lookup_backs_off(spark):
    cases = [
        ("A", "B", "SIL", "e", 4), ("A", "B", "SIL", "b", 4), ("A", "B", "SIL", "i", 5), ("A", "B", "+N+", "s", 4), ("A", "+N+", "+N+", "i", 8),
        ("A", "A", "A", "i", 0), ("B", "A", "A", "b", 1), ("+N+", "B", "SIL", "e", 3), ("A", None, None, None, 0), ("Z", "A", "A", "i", None), ("A", "B", "A", "e", 6),
    ]
    wanted = spark.createDataFrame([(n, *c[:4]) for n, c in enumerate(cases * 2)], "row int, base string, left string, right string, pos string")
    got = {r["row"]: r["id"] for r in crossword.lookup(wanted, definition(spark), ["+N+"]).collect()}
    assert [got[n] for n in range(2 * len(cases))] == [c[4] for c in cases * 2]


def test_contexts_across_words(spark):
    rows = [("u", 0, "+N+", 0), ("u", 1, "B", 1), ("u", 2, "A", 1), ("u", 3, "B", 2), ("u", 4, "A", 3), ("u", 5, "B", 3), ("u", 6, "A", 3), ("v", 0, "A", 0)]
    frame = spark.createDataFrame(rows, "key string, pos_no int, phone string, word int")
    got = [tuple(r)[4:] for r in crossword.contexts(frame, "key", ["+N+"]).orderBy("key", "pos_no").collect()]
    assert got == [
        ("+N+", "SIL", "B", "s"), ("B", "SIL", "A", "b"), ("A", "B", "B", "e"), ("B", "A", "A", "s"), ("A", "B", "B", "b"), ("B", "A", "A", "i"), ("A", "B", "SIL", "e"), ("A", "SIL", "SIL", "s"),
    ]


def test_states_of_base_phones(spark):
    d = definition(spark)
    bases = {r["state"]: r["base"] for r in crossword.base_of_states(d).collect()}
    assert bases[10] == "A" and bases[14] == "A" and bases[5] == "SIL" and bases[1] == "A"
    own = {r["state"]: r["ci_state"] for r in crossword.base_states(d).collect()}
    assert (own[10], own[11], own[12], own[13], own[14], own[2], own[1]) == (0, 1, 1, 0, 1, 2, 1)


def test_edge_tables_and_composites(spark):
    lexicon = spark.createDataFrame([(["B", "A"],), (["A", "B", "A"],), (["A"],), ([],)], "phones array<string>")
    last = {(r["base"], r["inner"]): r for r in crossword.edge_tables(lexicon, definition(spark), ["+N+"]).collect()}
    assert set(last) == {("A", "B"), ("A", None)}
    r = last["A", "B"]
    # Right contexts by name: +N+ (as silence), A, B, SIL.
    assert r["sequences"] == [[10, 11], [13, 11]] and r["places"] == {"+N+": 0, "A": 0, "B": 1, "SIL": 0}
    alone = last["A", None]
    assert alone["places"]["SIL SIL"] == alone["places"]["+N+ SIL"] and len(alone["places"]) == 16
    assert alone["sequences"][alone["places"]["SIL SIL"]] == [1, 14] and alone["sequences"][alone["places"]["A A"]] == [0, 1]
    first = {(r["base"], r["inner"]): r for r in crossword.edge_tables(lexicon, definition(spark), ["+N+"], end=False).collect()}
    assert set(first) == {("B", "A"), ("A", "B"), ("A", None)} and first["B", "A"]["sequences"] == [[2, 3]]
    assert first["A", "B"]["places"] == {"+N+": 0, "A": 0, "B": 1, "SIL": 0} and first["A", "B"]["sequences"] == [[0, 1], [13, 11]]
    sets = {(r["base"], r["inner"]): r["composites"] for r in crossword.composite_states(crossword.edge_tables(lexicon, definition(spark), ["+N+"])).collect()}
    assert sets["A", "B"] == [[10, 13], [11]]
