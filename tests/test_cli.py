import pytest

from tessera.cli import grid, human, main, shown
from tessera.schema import Schema
from tessera.sources import csv as source


class Run:
    def __init__(self, spark, *args):
        self.out, self.err = "", ""
        self.code = main([str(a) for a in args], self._out, self._err, spark)

    def _out(self, text, end="\n"):
        self.out += text + end

    def _err(self, text):
        self.err += text + "\n"


TICKETS = ["--pk", "ticket", "--schema", "ticket:int64,seat:int64,price:float64,hall:string"]


@pytest.fixture
def tickets(tmp_path):
    """Thirty-six tickets in three halls, and five of them sold again."""
    rows = [f"{7 * i + 3},{i % 12},{0.25 * i:.2f},{('red', 'blue', 'green')[i // 12]}" for i in range(36)]
    rows += [f"{7 * i + 3},0,80.00,void" for i in range(0, 35, 7)]
    (tmp_path / "t.csv").write_text("ticket,seat,price,hall\n" + "\n".join(rows) + "\n")
    return tmp_path


@pytest.mark.parametrize("extra, rejected", [([], "5"), (["--mode", "exact"], "5"), (["--no-bloom"], "—"), (["--mode", "exact", "--no-multiline"], "5")])
def test_load_query_inspect(spark, tickets, extra, rejected):
    r = Run(spark, "load", "--csv", tickets / "t.csv", "--out", tickets / "s", *TICKETS, *extra)
    assert r.code == 0 and r.err == ""
    lines = dict(x.split(":", 1) for x in r.out.strip().split("\n"))
    assert lines["rows read"].strip() == "41" and lines["rejected (BF)"].split()[0] == rejected
    assert lines["accepted"].strip() == ("41" if extra == ["--no-bloom"] else "36")
    if extra:
        return
    r = Run(spark, "query", "--db", tickets / "s", "SELECT hall, COUNT(*) GROUP BY hall")
    assert r.out.splitlines() == ["hall    COUNT(*)", "red     12", "blue    12", "green   12"]
    r = Run(spark, "query", "--db", tickets / "s", "--limit", 3, "SELECT ticket, price")
    assert r.out.splitlines() == ["ticket   price", "3        0", "10       0.25", "17       0.5", "(showing 3 of 36 rows; pass --limit 0 for all)"]
    r = Run(spark, "query", "--db", tickets / "s", "--limit", 3, "--format", "csv", "SELECT ticket")
    assert r.out.splitlines() == ["ticket", *(str(7 * i + 3) for i in range(36))]
    assert len(Run(spark, "query", "--db", tickets / "s", "--limit", 0, "SELECT ticket").out.splitlines()) == 37
    r = Run(spark, "query", "--db", tickets / "s", "--format", "csv", "--out", tickets / "parts", "SELECT price, hall WHERE seat = 4")
    assert r.code == 0 and r.out == ""
    parts = [p.read_text().splitlines() for p in sorted((tickets / "parts").glob("part-*"))]
    assert all(p[0] == "price,hall" for p in parts) and [x for p in parts for x in p[1:]] == ["1,red", "4,blue", "7,green"]
    assert Run(spark, "query", "--db", tickets / "s", "--out", tickets / "parts", "SELECT *").code == 1
    r = Run(spark, "inspect", tickets / "s")
    assert r.code == 0 and "ticket    int64      [PK]" in r.out and "rows:    36" in r.out and "m (bits):       9,585,059" in r.out


def test_errors_and_exit_codes(spark, tickets):
    assert Run(spark).code == 2 and Run(spark, "nope").code == 2 and Run(spark, "help").code == 0
    assert Run(spark, "version").out.startswith("tessera ")
    assert Run(spark, "load").code == 1 and Run(spark, "load", "--what").code == 2
    assert Run(spark, "load", "--csv", "x", "--out", "y", "--pk", "a", "--schema", "a:int").code == 1
    assert Run(spark, "load", "--csv", "x", "--out", "y", "--pk", "b", "--schema", "a:int64").code == 1
    assert "open csv" in Run(spark, "load", "--csv", tickets / "none", "--out", "y", "--pk", "a", "--schema", "a:int64").err
    assert "missing from CSV header" in Run(spark, "load", "--csv", tickets / "t.csv", "--out", tickets / "y", "--pk", "a", "--schema", "a:int64").err
    assert Run(spark, "query").code == 1 and Run(spark, "query", "--db", "x").code == 1
    assert Run(spark, "query", "--db", "x", "--format", "xml", "SELECT *").code == 1
    assert "open segment" in Run(spark, "query", "--db", tickets / "none", "SELECT *").err
    assert Run(spark, "inspect").code == 1 and Run(spark, "inspect", "-h").code == 0 and Run(spark, "inspect", tickets / "none").code == 1


def test_small_filter_warns_twice(spark, tickets):
    r = Run(spark, "load", "--csv", tickets / "t.csv", "--out", tickets / "s", *TICKETS, "--expected-items", 5)
    assert "planned for 5 keys" in r.err and "were asked for" in r.err


def test_bad_rows_are_warned_of_and_skipped(spark, tmp_path):
    rows = [f"{i},{'x' if i % 2 else '1.5'}" for i in range(25)]
    (tmp_path / "b.csv").write_text("id,amount\n" + "\n".join(rows))
    r = Run(spark, "load", "--csv", tmp_path / "b.csv", "--out", tmp_path / "s", "--pk", "id", "--schema", "id:int64,amount:float64")
    assert r.code == 0 and "accepted:         13" in r.out and "parse errors:     12" in r.out
    assert r.err.count("warn: row") == 10 and "warn: row 3: column \"amount\"" in r.err and "... 2 further rows don't fit, either" in r.err


def test_rows_are_numbered_over_all_parts_of_a_read(spark, tmp_path):
    rows = [f"{i},{'x' if i in (5, 2900) else '1.5'}" for i in range(3000)]
    (tmp_path / "b.csv").write_text("id,amount\n" + "\n".join(rows))
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        r = Run(spark, "load", "--csv", tmp_path / "b.csv", "--out", tmp_path / "s", "--pk", "id", "--schema", "id:int64,amount:float64", "--mode", "exact", "--no-multiline")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)
    assert r.code == 0 and "warn: row 7:" in r.err and "warn: row 2902:" in r.err


def test_long_headers(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(source, "HEAD", 8)
    names = [f"column {i} with a long name" for i in range(300)]
    (tmp_path / "c.csv").write_text("\n" + ",".join([*names, '"a\nb"']) + "\n" + ",".join(["1"] * 301) + "\n")
    assert source.header(spark, str(tmp_path / "c.csv")) == [*names, "a\nb"]
    (tmp_path / "d.csv").write_text("id")
    assert source.header(spark, str(tmp_path / "d.csv")) == ["id"]


def test_csv_corners(spark, tmp_path):
    text = (
        ' id ,amount,country,x\r\n1,1.5,"a,b",q\r\n2,2,,q\r\n3,3,"",q\r\n\r\n4,4\r\n5,5,five,q,more\r\n6,6,"say ""hi""",q\r\n7,7,"two\nlines",q\r\n'
        "8,1d,x,q\r\n9,1e400,x,q\r\n10,inf,x,q\r\n11,0x1p-2,x,q\r\n 12,1,x,q\r\n13,,x,q\r\n14,1,sh\r\n15,1,ba\"re\r\n,1,x,q\r\n9223372036854775808,1,x,q\r\n"
    )
    (tmp_path / "c.csv").write_bytes(text.encode())
    got = source.read(spark, str(tmp_path / "c.csv"), Schema.of("country:string,id:int64,amount:float64", "id"))
    good = {r.id: (r.country, r.amount) for r in got.good.collect()}
    assert good == {
        1: ("a,b", 1.5), 2: ("", 2.0), 3: ("", 3.0), 5: ("five", 5.0), 6: ('say "hi"', 6.0), 7: ("two\nlines", 7.0),
        10: ("x", float("inf")), 11: ("x", 0.25), 14: ("sh", 1.0),
    }
    bad = [r.reason for r in got.bad.orderBy("_seq").collect()]
    assert len(bad) == 8 and "missing field (CSV has 2 fields, want index 2)" in bad[0] and "csv read error" in bad[5]


def test_repeated_header_takes_the_last(spark, tmp_path):
    (tmp_path / "c.csv").write_text("id,a,id\n1,x,2\n")
    got = source.read(spark, str(tmp_path / "c.csv"), Schema.of("id:int64,a:string", "id"))
    assert [tuple(r)[:2] for r in got.good.collect()] == [(2, "x")]


def test_formatting():
    assert [shown(v) for v in (1.0, 1.5, -0.0, 1e6, 1e21, 1.5e-5, 1e-4, 123456789.125, float("inf"), float("-inf"), float("nan"), 7, "x")] == [
        "1", "1.5", "-0", "1000000", "1e+21", "1.5e-05", "0.0001", "123456789.125", "+Inf", "-Inf", "NaN", "7", "x",
    ]
    assert [human(n) for n in (0, 1023, 1024, 1536, 1 << 20, 3 << 30, 5 << 40)] == ["0 B", "1023 B", "1.0 KB", "1.5 KB", "1.0 MB", "3.0 GB", "5.0 TB"]
    assert grid([["a", "bb"], ["ccc", "d"]], 3) == "a     bb\nccc   d\n"


def test_stream_stays_unique(spark, tmp_path):
    from tessera.sources.segment import Segment
    from tessera.streaming.unique import unique_sink

    schema = Schema.of("id:int64,v:string", "id")
    src = tmp_path / "in"
    for i, ids in enumerate(([1, 2, 2], [2, 3], [1, 4])):
        spark.createDataFrame([(k, f"b{i}", j) for j, k in enumerate(ids)], "id long, v string, t long").coalesce(1).write.mode("append").json(str(src))
        stream = spark.readStream.schema("id long, v string, t long").json(str(src))
        q = unique_sink(stream, schema, str(tmp_path / "s"), "t").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
    assert Segment.open(spark, str(tmp_path / "s")).query("SELECT id, v").rows() == [(1, "b0"), (2, "b0"), (3, "b1"), (4, "b2")]
