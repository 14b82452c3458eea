import re
import signal

import duckdb
import pytest
from tests.conftest import SF
from tests.naive import fnv, key

import __spark_entry__ as entry
from lineweave import plans
from lineweave.cli import main
from lineweave.functions.grammar import parse
from lineweave.functions.sizes import describe_size, parse_size
from lineweave.operators import order
from lineweave.operators.generate import Options, lines, repeated_share, sized
from lineweave.operators.verify import multiset_diff
from lineweave.plans.resources import least_budget, merge_passes, plan_memory

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(columns, data):
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(([columns[i] for i in at], [repr(float(r[i]) if isinstance(r[i], float) else r[i]) for i in at]) for r in data)


@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_query_against_sql(spark, duck, name):
    df = plans.queries()[name](spark, SF)
    want = duck.sql(plans.oracle_sql()[name])
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(want.columns, want.fetchall())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_range_slices_cover_the_order(spark):
    relation = lines(spark, 3000, 7).select("line")
    sliced = order.ranges(parse(relation), 6)
    stats = order.balance(sliced, 6)
    assert sum(stats.rows) == 3000 and order.ordered_slices(sliced)
    assert stats.imbalance < 3
    one = order.ranges(parse(spark.range(500).selectExpr("CAST('7. same' AS BINARY) AS line")), 6)
    assert order.balance(one, 6).non_empty == 1 and order.balance(one, 6).imbalance == float("inf")


def test_ranks_of_one_key_spread_over_tasks(spark):
    """No task of the ranking gets all lines, even if all are equal."""
    same = parse(spark.range(4000).selectExpr("CAST('7. same' AS BINARY) AS line").repartition(4))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ranks = order.ranked(same)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(r["rank"] for r in ranks.select("rank").collect()) == list(range(1, 4001))
    files = {r["f"]: r["n"] for r in spark.read.parquet(*{f.rsplit("/", 1)[0] for f in ranks.inputFiles()}).groupBy("_metadata.file_path").count().toDF("f", "n").collect()}
    assert max(files.values()) < 3000


def test_sampled_splitters_are_near_the_exact_ones(spark):
    parsed = parse(lines(spark, 5000, 11, 0.0).select("line"))
    found = [r["slice"] for r in order.sampled_splitters(parsed, 8, 1000).collect()]
    assert sorted(found) == list(range(1, 8))
    cuts = {r["slice"]: bytes(r["line"]) for r in order.sampled_splitters(parsed, 8, 1000).collect()}
    ordered = [bytes(r["line"]) for r in order.sort_lines(parsed).collect()]
    assert all(abs(ordered.index(cuts[k]) - 5000 * k // 8) < 350 for k in cuts)
    assert order.sampled_splitters(parsed.limit(3), 8).count() == 2 and order.sampled_splitters(parsed.limit(0), 8).count() == 0


def test_generator_contract(spark):
    made = lines(spark, 4000, 3, 0.3).collect()
    assert all(key(bytes(r["line"])) == (r["string_part"].encode(), r["number"], bytes(r["line"])) for r in made)
    assert made[0]["string_part"] == made[1]["string_part"]
    share = repeated_share(lines(spark, 4000, 3, 0.3)).first()["share"]
    assert abs(share - 0.3) < 0.03
    assert repeated_share(lines(spark, 2000, 3, 0.0)).first()["share"] == 0
    small = [bytes(r["line"]) for r in sized(spark, Options(2000, 3)).collect()]
    large = [bytes(r["line"]) for r in sized(spark, Options(5000, 3)).collect()]
    assert large[: len(small)] == small and sum(len(x) + 1 for x in small) <= 2000 < sum(len(x) + 1 for x in large[: len(small) + 1])
    assert sized(spark, Options(0)).count() == 0


def test_multiset_diff(spark):
    a = spark.createDataFrame([(b"x",), (b"x",), (b"y",)], "line binary")
    b = spark.createDataFrame([(b"x",), (b"y",), (b"z",)], "line binary")
    assert {(bytes(r["line"]), r["surplus"]) for r in multiset_diff(a, b).collect()} == {(b"x", 1), (b"z", -1)}


def test_planners():
    p = plan_memory(4 << 30, 16, 65536)
    assert (p.chunk, p.fan_in, p.window, p.workers, p.phase_two) == (116_051_857, 2048, 87_193, 8, 4_294_557_696)
    assert plan_memory(4_698_304, 71, 64).workers == 3 and plan_memory(1_324_423, 20, 256).chunk == 304
    for cores, width in ((1, 64), (16, 65536), (20, 256)):
        least = least_budget(cores, width)
        assert plan_memory(least, cores, width) and plan_memory(least - 1, cores, width) is None
        assert max(plan_memory(least, cores, width).phase_one, plan_memory(least, cores, width).phase_two) <= least
    for runs, fan_in in ((5, 8), (9, 8), (3, 2), (100, 4), (617, 2048), (1000, 3)):
        n = runs
        for groups, carried in merge_passes(runs, fan_in):
            assert [i for g in [*groups, carried] for i in g] == list(range(n))
            assert all(2 <= len(g) <= fan_in for g in groups)
            n = len(groups) + len(carried)
        assert n == 1
    assert merge_passes(1, 2) == []


def test_sizes():
    assert [parse_size(x) for x in ("0", "7B", "1kib", "2MiB", "3GIB")] == [0, 7, 1024, 2 << 20, 3 << 30]
    assert all(parse_size(x) is None for x in ("", "B", "-1", "1 KiB", "1.5KiB", "9223372036854775808", "9007199254740993GiB", "１"))
    assert [describe_size(x) for x in (1023, 1024, 1048575, 5 << 30)] == ["1023 B", "1.0 KiB", "1.0 MiB", "5.0 GiB"]


def test_command_line(spark, tmp_path, capsys):
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    assert main(["generate", a, "--size", "20KiB", "--seed", "5"], spark) == 0
    assert main(["sort", a, b, "--max-line", "1KiB"], spark) == 0
    assert re.search(r"ranges hold lines, the largest [\d.inf]+ times the smallest; tasks took [\d.]+ to [\d.]+ s", capsys.readouterr().err)
    assert main(["verify", a, b], spark) == 0
    assert main(["--verify", a, a], spark) == 4
    (tmp_path / "bad").write_bytes(b"1. a\nbad\n")
    assert main(["sort", str(tmp_path / "bad"), b], spark) == 1
    assert 'Malformed line 2 at byte offset 5: "bad"' in capsys.readouterr().err
    for args in (["sort", a], ["sort", a, a], ["sort", a, b, "--memory", "x"], ["sort", a, b, "c"], ["sort", a, b, "--what"], ["sort", a, b, "--memory", "1KiB"],
                 ["sort", str(tmp_path / "none"), b], ["sort", a, b, "--parallelism", "0"], ["sort", a, b, "--pipeline", "z"], ["generate", a], ["generate", a, "--size", "1", "--duplicate-ratio", "nan"], [], ["zip"]):
        assert main(args, spark) == 3, args
    assert main(["--help"]) == 0


def test_signals_cancel_and_are_given_back(spark, tmp_path, monkeypatch):
    from lineweave import cli

    old = signal.getsignal(signal.SIGINT)
    with pytest.raises(KeyboardInterrupt), cli.cancellable(spark):
        signal.raise_signal(signal.SIGINT)
    assert signal.getsignal(signal.SIGINT) == old
    (tmp_path / "a").write_bytes(b"1. a\n")

    def stopped(*_):
        raise KeyboardInterrupt

    monkeypatch.setitem(cli.COMMANDS, "sort", stopped)
    assert main(["sort", "a", "b"], spark) == 130


def test_full_disk_is_refused(spark, tmp_path, monkeypatch, capsys):
    from lineweave import cli

    (tmp_path / "a").write_bytes(b"1. a\n" * 100)
    args = ["sort", str(tmp_path / "a"), str(tmp_path / "b")]
    monkeypatch.setattr(cli.shutil, "disk_usage", lambda _: cli.shutil._ntuple_diskusage(10**6, 10**6, 500))
    assert main(args, spark) == 2 and "lacks space" in capsys.readouterr().err and not (tmp_path / "b").exists()

    def unknown(_):
        raise OSError("no answer")

    monkeypatch.setattr(cli.shutil, "disk_usage", unknown)
    assert main(args, spark) == 0 and "is unknown" in capsys.readouterr().err


def test_streaming(spark, tmp_path):
    from lineweave.streaming.lines import read_lines, sorted_runs

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1").write_bytes(b"3. c\r\n1. a\nbad\n")
    (tmp_path / "in" / "2").write_bytes(b"2. b\n1. a\n")
    q = sorted_runs(read_lines(spark, str(tmp_path / "in")), str(tmp_path / "runs"), str(tmp_path / "bad"), str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert sorted(bytes(r["line"]) for r in spark.read.parquet(str(tmp_path / "runs")).collect()) == [b"1. a", b"1. a", b"2. b", b"3. c"]
    assert [bytes(r["line"]) for r in spark.read.parquet(str(tmp_path / "bad")).collect()] == [b"bad"]


def test_running_report(spark, tmp_path):
    from lineweave.streaming.lines import read_lines, running_report

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1").write_bytes(b"3. c\r\n1. a\nbad\n")
    (tmp_path / "in" / "2").write_bytes(b"2. b\n")
    report = running_report(read_lines(spark, str(tmp_path / "in"), 1))
    q = report.writeStream.outputMode("complete").format("memory").queryName("report").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    row = spark.table("report").first()
    assert (row["lines"], row["malformed"]) == (4, 1)
    assert (int(row["hash_high"] * 2**32 + row["hash_low"])) % 2**64 == sum(map(fnv, (b"3. c", b"1. a", b"bad", b"2. b"))) % 2**64
