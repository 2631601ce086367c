"""Structure of files: headers, sections, trailers, and what is wrong with them."""

from __future__ import annotations

import pytest

from tabulon.operators.table import TextTable
from tabulon.sources.layout import is_marker, read_layout, suggests_bulk

CLASSIC = """INAHDR
START-OF-FILE
DELIMITER=|
FIRMNAME=acme=x
START-OF-FIELDS
_ID
_ERR
PRICE
END-OF-FIELDS
TIMESTARTED=now
START-OF-DATA
SEC001 ZZ Note|0|88.20
SEC002 ZZ Note|0|97.35

SEC003 ZZ Note|0|12.90
END-OF-DATA   (3 records)
DATARECORDS=3
END-OF-FILE
INATRL
"""
BULK = """START-OF-FILE
DELIMITER=|
DATA=DVD_HIST
START-OF-FIELDS
EX_DATE
AMOUNT
END-OF-FIELDS
START-OF-DATA
a|0|2|20240101|1
b|0|2|20240102|2
END-OF-DATA
DATARECORDS=2
TIMEFINISHED=t1
START-OF-FIELDS|data=CALLS,x
CALL
END-OF-FIELDS
START-OF-DATA
END-OF-DATAX|not the end
c|0|1|9
END-OF-DATA
END-OF-FILE
DATARECORDS=5
"""


def put(tmp_path, text: str, name: str = "a.dif") -> str:
    at = tmp_path / name
    at.write_bytes(text.encode())
    return str(at)


def rows(t: TextTable) -> list[list[str]]:
    return [r["fields"] for r in t.df.orderBy("row_idx").collect()]


def test_classic(spark, tmp_path):
    lay = read_layout(put(tmp_path, CLASSIC))
    assert lay.valid and lay.marker == "INAHDR" and lay.has_file_start and lay.has_file_end and not lay.is_bulk
    s = lay.sections[0]
    assert (s.name, s.columns, s.declared_records, s.metadata) == ("Section 1", ("_ID", "_ERR", "PRICE"), 3, {"TIMESTARTED": "now"})
    assert lay.header == {"DELIMITER": "|", "FIRMNAME": "acme=x"} and lay.trailer == {"DATARECORDS": "3"} and not lay.diagnostics
    t = TextTable.of_section(spark, lay)
    assert rows(t) == [["SEC001 ZZ Note", "0", "88.20"], ["SEC002 ZZ Note", "0", "97.35"], ["SEC003 ZZ Note", "0", "12.90"]]
    assert lay.describe(0, 3)["columns"] == 3 and lay.describe(0, 3)["rows"] == 3


def test_last_end_wins_in_classic_files(tmp_path):
    lay = read_layout(put(tmp_path, CLASSIC.replace("SEC003 ZZ Note|0|12.90", "END-OF-DATA")))
    assert (tmp_path / "a.dif").read_bytes()[lay.sections[0].data_end :].startswith(b"END-OF-DATA   (3")


def test_bulk(spark, tmp_path):
    lay = read_layout(put(tmp_path, BULK))
    assert [s.name for s in lay.sections] == ["DVD_HIST", "CALLS"]
    assert lay.sections[0].columns == ("_ID", "_ERR", "_SIZE", "EX_DATE", "AMOUNT")
    assert lay.sections[0].declared_records == 2 and lay.sections[1].metadata["TIMEFINISHED"] == "t1"
    assert rows(TextTable.of_section(spark, lay, 1)) == [["END-OF-DATAX", "not the end"], ["c", "0", "1", "9"]]


def test_concatenated_envelopes_keep_their_names(tmp_path):
    one = "START-OF-FILE\nDATA={0}\nSTART-OF-FIELDS\nA\nEND-OF-FIELDS\nSTART-OF-DATA\nx|0|1|{0}\nEND-OF-DATA\nDATARECORDS=1\nEND-OF-FILE\n"
    lay = read_layout(put(tmp_path, "".join(one.format(n) for n in ("P", "Q", "R"))))
    assert [(s.name, s.declared_records) for s in lay.sections] == [("P", 1), ("Q", 1), ("R", 1)]


@pytest.mark.parametrize("chunk", [1, 7, 50, 1000])
def test_chunks_never_lose_or_repeat_rows(spark, tmp_path, chunk):
    text = CLASSIC.replace("\n\nSEC003", "\r\n" + "".join(f"é{i}|{i}|\r\n" for i in range(30)) + "SEC003")
    t = TextTable.open(spark, put(tmp_path, text), 0, chunk)
    got = rows(t)
    assert len(got) == 33 and got[2] == ["é0", "0", ""] and got[-1][0] == "SEC003 ZZ Note"
    assert sorted(r["row_idx"] for r in t.df.collect()) == list(range(33))


@pytest.mark.parametrize(("text", "errors", "warnings"), [
    ("nonsense\n", 1, 0), ("", 1, 0), ("INAHDR\nSTART-OF-FIELDS\nA\n", 1, 0), ("INAHDR\nDELIMITER=|\nSTART-OF-FIELDS\nEND-OF-FIELDS\nSTART-OF-DATA\n", 1, 0),
    ("INAHDR\nDELIMITER=|\nSTART-OF-FIELDS\nA\nEND-OF-FIELDS\nSTART-OF-DATA\na|0|1|b", 0, 2),
    ("INAHDR\nDELIMITER=||\nSTART-OF-FIELDS\nA\nEND-OF-FIELDS\nSTART-OF-DATA\nEND-OF-DATA\nINATRL\n", 0, 1),
])
def test_malformed(tmp_path, text, errors, warnings):
    found = read_layout(put(tmp_path, text)).diagnostics
    assert [sum(d.severity == s for d in found) for s in ("error", "warning")] == [errors, warnings]


def test_empty_data_and_delimiters(spark, tmp_path):
    t = TextTable.open(spark, put(tmp_path, "IMAHDR|x\nDELIMITER=\t\nSTART-OF-FIELDS\nA\nEND-OF-FIELDS\nSTART-OF-DATA\nEND-OF-DATA\nIMATRL\n"))
    assert rows(t) == [] and t.layout.delimiter == "\t" and t.layout.marker == "IMAHDR"


def test_markers_and_bulk_names():
    assert is_marker(b"END-OF-DATA (3)", b"END-OF-DATA") and not is_marker(b"END-OF-FIELDS_X", b"END-OF-FIELDS")
    assert suggests_bulk(r"C:\x\My_BULK.dif", b"") and not suggests_bulk("/bulk/a.dif", b"START-OF-FIELDS\n")


def test_lines_of_any_chunks(tmp_path, monkeypatch):
    """Chunks of any size give the lines that splitting all bytes gives, invalid bytes and lines over several blocks included."""
    import random

    from tabulon.sources import datasource

    r = random.Random(3)
    for batch in (7, 1 << 20):
        monkeypatch.setattr(datasource, "BATCH", batch)
        for _ in range(60):
            raw = b"".join(r.choice([b"a", b"\n", b"\r", b"\r\n", "é漢".encode(), b"\xc3", b"\xa9", b"|", b"long line "]) for _ in range(r.randint(0, 60)))
            path = tmp_path / "x"
            path.write_bytes(b"head\n" + raw)
            expected, where = [], 5
            for line in raw.split(b"\n"):
                kept = line[:-1] if line.endswith(b"\r") else line
                if kept:
                    expected.append((where, kept.decode("utf-8", "replace")))
                where += len(line) + 1
            for chunk in (1, 3, 16, 1000):
                reader = datasource.SectionReader({"path": str(path), "start": 5, "end": 5 + len(raw), "chunkbytes": chunk})
                rows = [x for p in reader.partitions() for b in reader.read(p) for x in b.to_pylist()]
                assert [(x["off"], x["raw"]) for x in rows] == expected, (raw, chunk, batch)
