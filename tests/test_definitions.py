"""Definition and topology files: round trips and errors."""

import pytest

from cadenza.sources import definitions
from tests.test_crossword import ROWS


def test_definition_files(spark, tmp_path):
    rows = [(i, b, le, r, p, "filler" if b in ("SIL", "+N+") else None, i % 3, s) for i, b, le, r, p, s in ROWS]
    frame = spark.createDataFrame(rows[::-1], "id long, base string, left string, right string, pos string, attrib string, tmat int, states array<int>").coalesce(1)
    lines = [r["line"] for r in definitions.definition_lines(frame).orderBy("line_no").collect()]
    assert lines[:8] == ["0.3", "4 n_base", "5 n_tri", "27 n_state_map", "13 n_tied_state", "8 n_tied_ci_state", "3 n_tied_tmat", "# base lft rt p attrib tmat states"]
    assert lines[8] == "    A   -   - -    n/a    0      0      1 N" and lines[12] == "    A   B SIL e    n/a    1     10     11 N"
    (tmp_path / "mdef").write_text("\n".join(lines))
    back = {(r["base"], r["lft"], r["rt"], r["wpos"]): (r["attrib"], r["tmat"], r["states"]) for r in definitions.checked_models(spark, str(tmp_path / "mdef")).collect()}
    assert back["SIL", "-", "-", "-"] == ("filler", 2, [4, 5]) and back["A", "B", "SIL", "i"] == ("n/a", 2, [10, 12]) and len(back) == 9
    (tmp_path / "less").write_text("\n".join(lines[:-1]))
    with pytest.raises(ValueError, match="n_tri is 4, the header has 5"):
        definitions.checked_models(spark, str(tmp_path / "less"))
    (tmp_path / "old").write_text("\n".join(["0.2", *lines[1:]]))
    with pytest.raises(ValueError, match="version"):
        definitions.checked_models(spark, str(tmp_path / "old"))


def test_topology_files(spark, tmp_path):
    def read(text):
        (tmp_path / "t").write_text(text)
        return {(r["i"], r["j"]): r["p"] for r in definitions.topology(spark, str(tmp_path / "t")).collect()}

    got = read("# three states\n0.1\n3\n1.0 1.0 0.0\n0.0 1.0 3.0\n")
    assert got == {(0, 0): 0.5, (0, 1): 0.5, (0, 2): 0.0, (1, 0): 0.0, (1, 1): 0.25, (1, 2): 0.75}
    for bad in ("0.1\n1.0 1.0 0.0\n0.0 1.0 1.0\n", "0.2\n2\n1 1\n", "0.1\n2\n0 0\n", "0.1\n3\n1 1 1\n", "0.1\n1\n", ""):
        with pytest.raises(ValueError):
            read(bad)
