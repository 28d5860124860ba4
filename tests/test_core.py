"""Functions, fields, records, ordered operators, edits and cuts."""

import random
import sqlite3

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from recordflow.functions import clock, codec, coerce, formatting, numeric, patterns
from recordflow.functions import text as T
from recordflow.operators import cut, edit, fields, folds, lookups, ordered
from recordflow.sources import records, stores


def one(spark, column, value="x"):
    return spark.createDataFrame([(value,)], "s string").select(column.alias("v")).first().v


@pytest.mark.parametrize("text,want", [("12abc", 12), ("--5", 5), ("-+-+5", 5), ("0x1Fz", 31), ("010", 8), ("010.5", 10.5), ("0b101", 5), ("0o17", 15), (" 3.5e2x", 350), ("abc", 0), ("", 0), (".", 0), (".5", 0.5), ("1d", 1)])
def test_numbers(spark, text, want):
    assert coerce.number(text) == want
    assert one(spark, coerce.to_number(F.col("s")), text) == want


def test_truth_and_division(spark):
    assert one(spark, coerce.truth(F.col("s"), "string"), "0") is True
    assert one(spark, coerce.truth(F.col("s"), "string"), "") is False
    assert one(spark, coerce.divide(F.lit(1.0), F.lit(0.0))) == float("inf")
    assert one(spark, coerce.int_divide(F.lit(-7), F.lit(2))) == -3
    assert one(spark, numeric.log(F.lit(0.0))) == float("-inf")
    assert one(spark, numeric.round_(F.lit(-2.5))) == -3.0


def test_patterns(spark):
    for p, s, want in [("[[:digit:]]+x", "12x", True), ("a{2}", "aa", True), ("[]a]+", "]a", True), ("a.b", "a\nb", True), ("[^[:space:]]", " ", False), ("[a[]", "[", True)]:
        assert one(spark, F.col("s").rlike(patterns.java(p)), s) is want
        assert (patterns.python(p).search(s) is not None) is want
    assert one(spark, F.regexp_extract("s", patterns.java("a|ab"), 0), "abc") == "ab"
    assert not one(spark, F.col("s").rlike(patterns.java("a{2}", bounds=False)), "aa")
    with pytest.raises(ValueError):
        patterns.java("[[:none:]]")


@pytest.mark.parametrize("how,want", [("g", "[a]bc[a]bc[a]"), (1, "[a]bcabca"), (2, "abc[a]bca"), (3, "abcabc[a]"), (4, "abcabca"), (0, "[a]bcabca"), ("", "[a]bcabca")])
def test_gensub(spark, how, want):
    assert one(spark, T.gensub(F.col("s"), "a", "[&]", how), "abcabca") == want
    assert one(spark, T.gensub(F.col("s"), "(a)(b)?", r"[\1]" if how != "g" else "[&]", how), "aXbcaXbca") is not None


def test_text(spark):
    s = F.col("s")
    assert one(spark, T.gensub(s, "(o)(.)", r"\2\1$", 2), "foo bor") == "foo bro$"
    assert one(spark, T.gsub(s, "o", r"\&$&")[0], "foo") == "f&$o&$o"
    assert one(spark, T.substr(s, -1, 3), "hello") == "hel"
    assert [one(spark, T.index(s, "l", k), "hello") for k in (1, 4, 0, -2, 9)] == [3, 4, 3, 4, 0]
    assert [one(spark, T.rindex(s, "l", k), "hello") for k in (None, 3, -2)] == [4, 3, 4]
    assert one(spark, T.match(s, "l+"), "hello")[:2] == (3, 2) and one(spark, T.match(s, "z"), "hello")[:2] == (0, -1)
    assert one(spark, T.is_class(s, "isalpha"), "") == 0 and one(spark, T.is_class(s, "isalpha"), "aé") == 1
    assert one(spark, T.from_char_codes(F.lit(9918), F.lit(65))) == chr(9918) + "A"
    assert one(spark, T.char_code(s, 2), "aé") == 233 and one(spark, T.char_code(s, 9), "a") is None
    assert one(spark, T.trim(s), " a  b ") == "a  b" and one(spark, T.trim(s, True), " a  b ") == "a b"
    assert one(spark, T.to_num(s, 16), "ffz") == 255 and one(spark, T.subchar(s, 9), "abc") is None
    assert bytes(one(spark, T.from_byte_codes(F.lit(72), F.lit(300)))) == b"H,"


@pytest.mark.parametrize("fmt,args,want", [("%5.2f|%-5s|%05d", [3.14159, "ab", 42], " 3.14|ab   |00042"), ("%*.*d", [0, 3, 0], "000"), ("%.d", [0], ""), ("%c%c", [65, "xyz"], "Ax"), ("%x %o %#x %b", [255, 8, 255, 5], "ff 10 0xff 101"), ("%d", ["3.7x"], "3"), ("%g", [0.0001], "0.0001"), ("%v %v", [None, 5], "<@nil> 5"), ("%%", [], "%"), ("%+d % d", [3, 3], "+3  3"), ("%.2s", ["abc"], "ab")])
def test_sprintf(fmt, args, want):
    assert formatting.sprintf_text(fmt, args) == want


@pytest.mark.parametrize("fmt", ["%d|%s|%.2f", "%8d|%-6s|%10.3f", "%08d|%.2s|%-9.1f|", "%+d %5s %.0f%%", "%x:%s:%f", "%-5i<%12s>%.15f", "%016x %s %.1f"])
def test_sprintf_built_in_as_by_the_row(spark, fmt):
    rows = [(n, t, x) for n in (0, 7, -12, 123456789012, None) for t, x in (("ab", 0.125), ("", 2.675), (None, -0.05), ("äö longer", 1e15 + 0.25), ("z", float("inf")), ("q", float("nan")), ("w", 0.25), ("v", 0.35), ("u", None))]
    df = spark.createDataFrame(rows, "n bigint, t string, x double")
    kinds = ["bigint", "string", "double"]
    built = formatting.sprintf(fmt, df.n, df.t, df.x, kinds=kinds)
    plan = df.select(built.alias("s"))
    assert "Arrow" not in plan._jdf.queryExecution().toString()
    want = [formatting.sprintf_text(fmt, [n, "" if t is None else t, 0.0 if x is None else x]) for n, t, x in rows]
    assert [r.s for r in plan.collect()] == want


def test_sprintf_needs_its_arguments(spark):
    with pytest.raises(ValueError):
        formatting.sprintf_text("%d %d", [1])
    with pytest.raises(ValueError):
        formatting.sprintf("%d %s", F.col("a"))


@given(st.floats(-1e12, 1e12), st.integers(0, 12), st.sampled_from("eEfgG"))
@settings(max_examples=60, deadline=None)
def test_floats_print_as_c(x, precision, kind):
    assert formatting.sprintf_text(f"%.{precision}{kind}", [x]) == f"%.{precision}{kind}" % x


def test_times(spark):
    assert one(spark, clock.strftime("%F %T %j %U %W %u %e%%", F.lit(86400 * 45 + 3661))) == "1970-02-15 01:01:01 046 07 06 7 15%"
    assert one(spark, clock.mktime(F.lit("1970 13 32 25 00 00"))) == 86400 * (365 + 32) + 3600
    assert one(spark, clock.mktime(F.lit("1970"))) == -1
    assert one(spark, clock.basename(F.lit("/a/b.c"))) == "b.c" and one(spark, clock.dirname(F.lit("/a/b.c"))) == "/a"


def test_json_and_packing(spark):
    got = one(spark, codec.json_paths(F.col("s")), '{"a": [1, {"b": null}], "c": "x"}')
    assert [(r.path, r.value) for r in got] == [("a[1]", "1"), ("a[2].b", None), ("c", "x")]
    assert bytes(one(spark, codec.pack(">hq", F.lit(1), F.lit(2)))) == b"\0\1" + b"\0" * 7 + b"\2"


@pytest.mark.parametrize("fs,text,want", [(" ", "  a b\t c ", ["a", "b", "c"]), (" ", "   ", []), (",", "a,,b,", ["a", "", "b", ""]), (",", "", []), ("", "abc", ["a", "b", "c"]), ("[0-9]+", "a1b22c", ["a", "b", "c"]), ('?,"""', 'a, "b ""q"", c" ,d', ["a", 'b "q", c', "d"]), ("?,\\[]", "a,[b,\\]c],d\\,e", ["a", "b,]c", "d,e"])])
def test_split(spark, fs, text, want):
    assert one(spark, fields.split(F.col("s"), fs), text) == want


def test_field_changes(spark):
    f = fields.split(F.col("s"))
    assert one(spark, fields.join(fields.assign(f, 4, F.lit("d"))), "a b") == "a b  d"
    assert one(spark, fields.join(fields.resize(f, 1)), "a b") == "a" and one(spark, fields.join(fields.resize(f, 0)), "a b") == ""
    assert one(spark, fields.field(f, 9), "a b") == ""
    with pytest.raises(ValueError):
        fields.resize(f, -1)


@pytest.mark.parametrize("rs,text,want", [(None, "a\r\nb\nc", ["a", "b", "c"]), ("", "\n\na\nb\n\n\nc\n", ["a\nb", "c"]), ("x", "axbx", ["a", "b"]), ("[0-9]+", "a1b22c\n", ["a", "b", "c\n"]), ("x", "a\nb\n", ["a\nb\n"])])
def test_records(spark, tmp_path, rs, text, want):
    (tmp_path / "one").write_bytes(text.encode())
    (tmp_path / "two").write_bytes(text.encode())
    got = records.read(spark, [str(tmp_path / "one"), "v=5", str(tmp_path / "two")], rs).orderBy("nr").collect()
    assert [r.record for r in got] == want * 2 and [r.fnr for r in got] == [*range(1, len(want) + 1)] * 2
    assert [r.nr for r in got] == [*range(1, 2 * len(want) + 1)] and {(r.file_idx, r.v) for r in got} == {(0, None), (1, "5")}


def test_records_of_many_blocks(spark, tmp_path):
    """A large file is numbered by its blocks, a file named twice comes twice, and names may hold blanks."""
    lines = [f"line {i} " + "x" * (i % 50) for i in range(20_000)]
    (tmp_path / "a large one").write_text("\n".join(lines))
    (tmp_path / "b").write_text("only\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "60000")
    try:
        big, small = str(tmp_path / "a large one"), str(tmp_path / "b")
        got = records.read(spark, [small, big, "__block=1", "x=2", small]).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    got.sort(key=lambda r: r.nr)
    assert [r.record for r in got] == ["only", *lines, "only"] and [r.nr for r in got] == [*range(1, len(lines) + 3)]
    assert [r.fnr for r in got] == [1, *range(1, len(lines) + 1), 1] and got[-1]["__block"] == "1" and got[0]["x"] is None
    with pytest.raises(ValueError, match="nr"):
        records.read(spark, ["nr=1", small])


def test_quoted_records(spark, tmp_path):
    (tmp_path / "q").write_text('1,"a\nb",2\n3,"x ""y""", z \n')
    got = records.read_quoted(spark, [str(tmp_path / "q")], '?,"""').orderBy("fnr").collect()
    assert [r.fields for r in got] == [["1", "a\nb", "2"], ["3", 'x "y"', "z"]]


def test_stores(spark, tmp_path):
    path = str(tmp_path / "t.db")
    db = stores.Sqlite(spark, path)
    db.exec("create table t(id integer primary key, name text, score real)")
    assert db.exec("insert into t values (?, ?, ?), (?, ?, ?)", (1, "alice", 1.5, 2, "bob", 2)) == 2
    assert [tuple(r) for r in db.query("select * from t order by id").collect()] == [(1, "alice", 1.5), (2, "bob", 2.0)]
    assert sqlite3.connect(path).execute("select count(*) from t").fetchone() == (2,)
    (tmp_path / "net").write_text("package net\nconfig iface 'lan'\n\toption ip '1.2.3.4'\n\tlist dns 'a'\n\tlist dns 'b'\nconfig rule\n\toption x \"q r\" # c\n")
    got = {(r.section, r.option, r.value, r.place) for r in stores.read_config(spark, str(tmp_path / "net")).collect()}
    assert got == {("lan", None, None, 0), ("lan", "ip", "1.2.3.4", 0), ("lan", "dns", "a", 0), ("lan", "dns", "b", 1), ("@rule[0]", None, None, 0), ("@rule[0]", "x", "q r", 0)}
    with pytest.raises(PermissionError):
        stores.command(spark, "echo hi")
    assert stores.command(spark, "printf 'a\\nb\\n'", allow=True).count() == 2
    df = spark.createDataFrame([("x", None), ("y", "2")], "a string, b string")
    stores.print_to(df, str(tmp_path / "out"), "a", "b", ofs="-", destination="a")
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "out")).collect()) == ["x-", "y-2"]


@pytest.fixture(scope="module")
def many(spark):
    """100,000 rows in no order, with long and short keys and columns that the ordered operators might have named so themselves."""
    rng = random.Random(4)
    rows = [(i, rng.choice("aaaaaaab") if i % 9 else f"k{i % 700}", rng.random(), rng.random() < 0.01, "x", 1) for i in range(100_000)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "id int, k string, v double, hit boolean, __range string, __start_v0 int").repartition(6)
    return df, sorted(rows)


@pytest.fixture(params=[True, False])
def exchanges(spark, request):
    """With and without the reuse of exchanges, over eight ranges."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.exchange.reuse", str(request.param).lower())
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    yield
    spark.conf.set("spark.sql.exchange.reuse", "true")
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_ordered_over_many_rows(spark, many, exchanges):
    df, rows = many
    got = ordered.numbered(ordered.numbered(df, ["id"], "fnr", ["k"]), ["id"])
    assert got.columns == [*df.columns, "fnr", "nr"]
    seen: dict = {}
    want = {}
    for i, r in enumerate(rows, 1):
        seen[r[1]] = seen.get(r[1], 0) + 1
        want[r[0]] = (i, seen[r[1]])
    assert {r.id: (r.nr, r.fnr) for r in got.collect()} == want

    before: dict = {}
    lags, high, sums = {}, {}, {}
    total = 0
    for i, k, v, hit, *_ in rows:
        lags[i] = before.get(k)
        before[k] = v
        high[k] = max(high.get(k, 0), v)
        sums[i] = (total, high[k])
        total += i
    assert {r.id: r.prev for r in ordered.lag(df, "v", ["id"], "prev", ["k"]).collect()} == lags
    below = ordered.running(df, ["id"], {"below": ("sum", F.col("id"))}, inclusive=False)
    both = ordered.running(below, ["id"], {"high": ("max", F.col("v"))}, ["k"])
    assert {r.id: (r.below, r.high) for r in both.collect()} == sums

    opens, last, session = {}, {}, {}
    for i, k, *_ in rows:
        opens[k] = opens.get(k, 0) + (k not in last or i - last[k] > 3)
        last[k] = i
        session[i] = opens[k]
    assert {r.id: r.session for r in ordered.sessions(df, F.col("id"), 3, ["id"], ["k"]).collect()} == session


def test_range_pattern_over_many_rows(spark, many, exchanges):
    df, rows = many
    for by in (None, ["k"]):
        on: dict = {}
        want = []
        for i, k, v, hit, *_ in rows:
            key = k if by else None
            if on.get(key) or hit:
                want.append(i)
                on[key] = not v < 0.02
        got = ordered.range_pattern(df, F.col("hit"), F.col("v") < 0.02, ["id"], by)
        assert sorted(r.id for r in got.collect()) == want and got.columns == df.columns


def test_ranked_and_moving_over_many_rows(spark, many, exchanges):
    df, rows = many
    df = df.withColumn("place", (F.col("v") * 50).cast("int"))
    by_key: dict = {}
    for i, k, v, *_ in rows:
        by_key.setdefault(k, []).append((int(v * 50), i, v))
    want, means = {}, {}
    for some in by_key.values():
        places = sorted(p for p, *_ in some)
        steps = {p: n for n, p in enumerate(dict.fromkeys(places), 1)}
        first = {}
        for n, p in enumerate(places, 1):
            first.setdefault(p, n)
        for p, i, _ in some:
            want[i] = (first[p], steps[p], round((first[p] - 1) / (len(some) - 1), 9) if len(some) > 1 else 0.0)
        for n, (_, i, _) in enumerate(some):
            part = [v for _, _, v in some[max(0, n - 4) : n + 1]]
            means[i] = sum(part) / len(part)
    got = ordered.ranked(df, ["place"], ["k"], rank="r", dense="d", share="s")
    assert {r.id: (r.r, r.d, round(r.s, 9)) for r in got.collect()} == want
    got = ordered.moving(df, "v", ["id"], 5, "m", ["k"]).collect()
    assert all(abs(r.m - means[r.id]) < 1e-9 for r in got) and len(got) == len(rows)
    w = Window.partitionBy("k").orderBy("id")
    got = ordered.ranked(df, ["id"], ["k"], tiles=("t", 7)).withColumn("u", F.ntile(7).over(w))
    assert got.where("t <> u").count() == 0


def test_ordered_keys_of_other_kinds(spark):
    rows = [(None, "2024-01-01 00:00:00", 1), ("b", None, 2), ("b", "2023-06-01 00:00:00.5", 3), (None, "2022-01-01 00:00:00", 4), ("a", "2022-01-01 00:00:00", 5)]
    df = spark.createDataFrame(rows, "k string, at string, id int")
    for kind in ("timestamp", "timestamp_ntz", "date", "string"):
        timed = df.withColumn("at", F.col("at").cast(kind))
        got = ordered.running(timed, ["at", "id"], {"n": ("count", F.lit(1)), "low": ("min", F.col("at"))}, ["k"], ranges=3).collect()
        assert {r.id: r.n for r in got} == {4: 1, 1: 2, 2: 1, 3: 2, 5: 1}
        nothing = ordered.numbered(timed.where("id > 9"), ["at"], by=["k"])
        assert nothing.count() == 0 and ordered.range_pattern(timed.limit(0), F.lit(True), F.lit(True), ["id"]).count() == 0


def test_range_pattern_against_a_loop(spark):
    rng = random.Random(2)
    rows = [(i, rng.random() < 0.2, rng.random() < 0.3) for i in range(300)]
    on, want = False, []
    for i, a, b in rows:
        if on or a:
            want.append(i)
            on = not b
    df = spark.createDataFrame(rows, "i int, a boolean, b boolean").repartition(5)
    assert sorted(r.i for r in ordered.range_pattern(df, F.col("a"), F.col("b"), ["i"]).collect()) == want
    assert [r.nr for r in ordered.numbered(df, ["i"]).orderBy("i").collect()] == list(range(1, 301))
    assert ordered.until(df, F.col("i") == 10, ["i"]).count() == 11 and ordered.until(df, F.col("i") == 999, ["i"]).count() == 300


def test_folds(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 3, "z")], "k string, n int, v string")
    assert {tuple(r) for r in folds.last(df, ["k"], ["n"], v="v").collect()} == {("a", "y"), ("b", "z")}
    assert {tuple(r) for r in folds.joined(df, ["k"], ["n"], "v", "+").collect()} == {("a", "x+y"), ("b", "z")}
    assert {tuple(r) for r in folds.distinct_first(df, ["k"], ["n"]).collect()} == {("a", 1, "x"), ("b", 3, "z")}
    assert lookups.intersect_keeping(df.where("n < 3"), df.union(df)).count() == 4


SCRIPTS = ["s/o/0/g", "s/e/E/2", "2d", "2,4d", "/three/,/seven/d", "$d", "1~2d", "2,+1p", "N;s/\\n/,/", "1!G;h;$!d", "y/abc/xyz/", ":a;s/e/X/;ta", "2q", "=", "2i\\\nhello", "2,3c\\\nchanged", "n;d", "$!N;P;D", "x;p;x", "/o/{s/o/[&]/;p}", "s/[[:alpha:]]+/<&>/2", "l", "2,~4d", "b x;s/./Z/;:x;s/$/!/"]
TEXT = "one two\nthree four\nfive six\nseven\neight nine ten\n\nfoo=bar\nlast"


@pytest.mark.parametrize("script", SCRIPTS)
def test_edits_as_the_system_does_them(script):
    import shutil
    import subprocess

    if not shutil.which("sed"):
        pytest.skip("no system editor")
    want = subprocess.run(["sed", "-E", script], input=TEXT + "\n", capture_output=True, text=True, check=False).stdout
    assert edit.edit_text(TEXT, script) + "\n" == want


@pytest.mark.parametrize("script", ["s/o/0/g;/e/d", "2~2d", "y/abc/xyz/;p", "=;3z", "/five/!s/$/!/"])
def test_pure_edits_agree_with_the_machine(spark, script):
    assert edit.is_pure(edit.parse(script))
    df = spark.createDataFrame(list(enumerate(TEXT.split("\n"), 1)), "nr bigint, line string")
    got = [r.line for r in edit.edit(df, script).orderBy("nr", "at").collect()]
    assert "\n".join(got) == edit.edit_text(TEXT, script)


@pytest.mark.parametrize("script,text,want", [("f2", "a b c", "b"), ("f3-1", "a b c", "c b a"), ("f2-", "a b c", "b c"), ("d:,f1,f3", "a:b:c", "a:c"), ("d:-,f1-2", "a:b:c", "a-b"), ("c2-3", "abcd", "bc"), ("c3-2,c1", "abcd", "cba"), ("f9", "a b", "")])
def test_cuts(spark, script, text, want):
    assert one(spark, cut.cut(F.col("s"), script), text) == want
    assert edit.cut_text(text, script) == want


def test_streams(spark, tmp_path):
    from recordflow.streaming import streams

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a").write_text("x 1\ny 2\nx 3\n")
    src = streams.lines(spark, str(tmp_path / "in"))
    assert sorted(r.line for r in streams.run_to_memory(streams.rules(src, "$2 + 0 > 1 { print $1 }"), "rules_out").collect()) == ["x", "y"]
    counts = streams.keyed_count(src, fields.field(fields.split(F.col("record")), 1))
    assert {tuple(r) for r in streams.run_to_memory(counts, "counts_out", "complete").collect()} == {("x", 2), ("y", 1)}
    with pytest.raises(ValueError):
        streams.rules(src, "{ t++; print t }")


def test_registered_queries():
    import __spark_entry__ as entry

    names, sql = entry.queries(), entry.oracle_sql()
    assert "word_frequency" in names and set(sql) <= set(names)
