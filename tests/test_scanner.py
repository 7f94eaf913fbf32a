import gzip
import random

import pytest

from ledgerlark.functions.registry import GateError
from ledgerlark.sources import files, scanner


def sequential(text):
    """Rows of a text, one character after another."""
    rows, row, cell, quoted, k = [], [], "", False, 0
    while k < len(text):
        c = text[k]
        if quoted:
            if c == '"' and text[k + 1 : k + 2] == '"':
                cell, k = cell + '"', k + 1
            elif c == '"':
                quoted = False
            else:
                cell += c
        elif c == '"':
            quoted = True
        elif c in ",\n":
            row, cell = [*row, cell], ""
            if c == "\n":
                rows, row = [*rows, row], []
        elif c != "\r":
            cell += c
        k += 1
    if quoted:
        return None
    return rows + ([[*row, cell]] if cell or row else [])


@pytest.fixture
def split(spark):
    """Reads files in ranges of a few bytes."""
    names = {"spark.sql.files.maxPartitionBytes": "40", "spark.sql.files.openCostInBytes": "1", "spark.sql.files.minPartitionNum": "1"}
    for name, value in names.items():
        spark.conf.set(name, value)
    yield spark
    for name in names:
        spark.conf.unset(name)


def test_cells_of_a_row():
    for row in ['a"q"b', '"x,y",z', 'a,"b""c",', '""', '""""', 'a\r,b', '"a\r",b', '"a"\r"b"', "", ",,", '"a""b"', 'x"",y"1"']:
        assert scanner.cells(row) == sequential(row + "\n")[0], row


def test_many_ranges_equal_a_sequential_scan(split, tmp_path):
    rng = random.Random(4)
    some = ["", "a", "日本", '"q"', '"x,y"', '"two\nlines"', 'm"i"d', '"he said ""no"""', "cr\r", '"' + "long\n" * 30 + '"', '"\r\n"', " b "]
    for trial in range(5):
        folder, whole = tmp_path / f"t{trial}", []
        folder.mkdir()
        for n in range(3):
            text = "h1,h2,h3\n" + "".join(",".join(rng.choices(some, k=3)) + rng.choice(["\n", "\r\n"]) for _ in range(rng.randint(1, 40)))
            text = text.rstrip("\n") if trial % 2 else text
            (folder / f"f{n}.csv").write_bytes(text.encode())
            whole += sequential(text)[1:]
        rows = files.read_bulk_csv(split, str(folder))
        got = sorted(tuple(r) for r in rows.collect())
        assert sorted(rows.rdd.glom().map(len).collect())[-1] < len(whole) or len(whole) < 5
        assert sorted((*row, k + 2) for k, row in enumerate(whole)) == got
        assert len(scanner.layout(split, str(folder)).starts) > 6


@pytest.mark.parametrize(
    "text, message",
    [('a,b\n1,"open\n2,3\n', "left open"), ("a,b\n1,2\n\n3,4\n", "another number"), ("a,b\n1\n", "another number"), ("a,b\n1,2,3\n", "another number"), ("", "empty"), ('a,b\n"1,2"\n', "another number"), ("a, a\n1,2\n", "duplicate")],
)
def test_breaches_are_refused(split, tmp_path, text, message):
    (tmp_path / "bad.csv").write_text(text)
    with pytest.raises(GateError, match=message):
        files.read_bulk_csv(split, str(tmp_path / "bad.csv"))


def test_files_of_a_folder_have_one_header(split, tmp_path):
    (tmp_path / "a.csv").write_text("a,b\n1,2\n")
    (tmp_path / "b.csv").write_text("a,c\n1,2\n")
    with pytest.raises(GateError, match="another header"):
        files.read_bulk_csv(split, str(tmp_path))


def test_evidence_keeps_files_and_their_order(split, tmp_path):
    """A folder's small first file and large later ones, which the reader deals to tasks by size."""
    folder, raw = tmp_path / "csv", []
    folder.mkdir()
    for n, rows in enumerate((1, 30, 3, 60, 0, 12)):
        raw.append("h1,h2\n" + "".join(f'{n}-{k},"two\nlines, ""{k}"""\n' if k % 3 else f"{n}-{k},\n" for k in range(rows)))
        (folder / f"f{n}.csv").write_text(raw[-1])
    for name, size in (("small", "40"), ("whole", "100000")):
        split.conf.set("spark.sql.files.maxPartitionBytes", size)
        files.write_lines(split, str(folder), f"{tmp_path}/{name}")
        parts = sorted((tmp_path / name).glob("part-*.gz"))
        assert b"".join(gzip.decompress(p.read_bytes()) for p in parts).decode() == "".join(raw) and (len(parts) > 6) == (name == "small")
        got = sorted(map(tuple, files.read_bulk_csv(split, f"{tmp_path}/{name}", parts=True).collect()))
        assert got == sorted(map(tuple, files.read_bulk_csv(split, str(folder)).collect())) and sorted(r[2] for r in got) == list(range(2, 108))
        assert [r[0] for r in sorted(got, key=lambda r: r[2])] == [f"{n}-{k}" for n, rows in enumerate((1, 30, 3, 60, 0, 12)) for k in range(rows)]
