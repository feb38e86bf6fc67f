"""Files cut into ranges of any size against a walk over the whole file."""

import random

import pytest
from pyspark.sql import functions as F

from perigee.sources import elements, scan


@pytest.fixture
def cut(spark):
    """Sets the bytes of a range; the usual setting comes back."""
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
    before = {k: spark.conf.get(k, None) for k in keys}

    def use(n):
        spark.conf.set(keys[0], str(n))
        spark.conf.set(keys[1], "0")

    yield use
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def element_lines(r, n):
    out = []
    for i in range(n):
        number = f"{10000 + i}"
        block = [f"0 OBJECT {i}", f"1 {number}U 98067A   24001.00000000", f"2 {number}  51.6000 010.0000"]
        kind = r.random()
        if kind < 0.15:
            block[2] = block[2].replace(number, "99999")  # numbers differ
        elif kind < 0.25:
            block.insert(r.randrange(4), r.choice(["", "   ", "garbage", "1 77777U", "2 77777  1"]))
        elif kind < 0.3:
            block = block[1:]  # no name: the line before it serves
        elif kind < 0.35:
            block = block[: r.randint(0, 2)]
        elif kind < 0.4:
            block += block[1:]
        out += block
    return out


def by_hand(text):
    lines = [x.strip() for x in text.split("\n") if x.strip()]
    digits = lambda x: "".join(c for c in x if c.isdigit())

    def pairs(a, b):
        if not (a.startswith("1 ") and b.startswith("2 ")):
            return False
        one, two = digits(a[2:7]), digits(b.split()[1])
        return bool(one) and bool(two) and two.startswith(one)

    out, i = [], 0
    while i + 2 < len(lines):
        if pairs(lines[i + 1], lines[i + 2]):
            name = lines[i][2:] if lines[i].startswith("0 ") else lines[i]
            out.append((len(out), name.strip(), lines[i + 1], lines[i + 2]))
            i += 3
        else:
            i += 1
    return out


@pytest.mark.parametrize("size", [37, 90, 700, 1 << 20])
def test_one_file_over_many_ranges(spark, tmp_path, cut, size):
    text = "\n".join(element_lines(random.Random(3), 60))
    (tmp_path / "a.txt").write_text(text)
    (tmp_path / "b.txt").write_text("\n".join(element_lines(random.Random(4), 9)) + "\n")
    (tmp_path / "c.txt").write_text("\n\n")
    (tmp_path / "d.txt").write_text("1 5U\n2 5 1")
    cut(size)
    if size < 1000:
        assert scan.lines(spark, str(tmp_path)).select("path", "start").distinct().count() > 8
    got = {}
    for r in scan.tle_blocks(spark, str(tmp_path)).collect():
        got.setdefault(r.path[-5:], []).append((r.block, r.name, r.line1, r.line2))
    for f in "abcd":
        assert sorted(got.get(f"{f}.txt", [])) == by_hand((tmp_path / f"{f}.txt").read_text()), f
    whole = elements.tle_blocks(spark.createDataFrame([("a", text)], "path string, text string")).select("block", "name", "line1", "line2").collect()
    assert sorted(map(tuple, whole)) == sorted(got["a.txt"])


@pytest.mark.parametrize("size", [64, 300, 1 << 20])
def test_tables_between_marks(spark, tmp_path, cut, size):
    r = random.Random(5)
    rows = []
    for k in range(4):
        rows += ["header, a, b, c, d, e, f, g, h"] * r.randint(1, 5) + ["$$SOE"]
        rows += [f"24603{k}{i:02d}.5, A.D. 2024-Jan-{i % 28 + 1:02d} 00:00:00.0000, {i}.1234567, 2, 3, 4, 5, 6," if i % 7 else "short, row" for i in range(1, 40)]
        rows += ["$$EOE", "footer, 1, 2, 3, 4, 5, 6, 7"]
    text = "\n".join(rows)
    (tmp_path / "h.txt").write_text(text)
    cut(size)
    values = ["ts", "x", "y", "z", "vx", "vy", "vz"]
    want = elements.horizons_rows(spark.createDataFrame([("h", text)], "path string, text string")).orderBy("i").select(*values).collect()
    got = scan.horizons(spark, str(tmp_path)).orderBy("path", "start", "at").select(*values).collect()
    assert got == want and len(got) == 4 * 34


def test_empty_folder_and_file(spark, tmp_path):
    (tmp_path / "e.txt").write_text("")
    assert scan.tle_blocks(spark, str(tmp_path)).count() == 0 and scan.horizons(spark, str(tmp_path)).count() == 0


def test_joins_that_shuffle_give_the_same(spark, tmp_path, cut):
    (tmp_path / "a.txt").write_text("\n".join(element_lines(random.Random(8), 40)))
    cut(200)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    want = sorted(map(tuple, scan.tle_blocks(spark, str(tmp_path)).collect()))
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        assert sorted(map(tuple, scan.tle_blocks(spark, str(tmp_path)).collect())) == want and want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_lines_keep_their_order(spark, tmp_path, cut):
    (tmp_path / "n.txt").write_text("\n".join(str(i) for i in range(500)))
    cut(100)
    got = [int(r.line) for r in scan.lines(spark, str(tmp_path)).orderBy("path", "start", "at").select(F.col("line")).collect()]
    assert got == list(range(500))
