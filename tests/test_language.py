"""The record language, run record by record and as plans."""

import pytest

from recordflow.plans.grammar import parse
from recordflow.plans.host import sqlite_module, stores
from recordflow.plans.program import compile_program, execute, run_program
from recordflow.plans.sequential import Interpreter

RECORDS = ("alpha beta 3", "gamma delta 4", "alpha x 5")


def run(text, records=RECORDS, **options):
    options.setdefault("files", {"side": "l1\nl2\n"})
    out = Interpreter(parse(text), **options).run(("f", i, r) for i, r in enumerate(records, 1))
    return "".join(x for _, _, x in out)


CASES = [
    ("{ print $1, NF }", "alpha 3\ngamma 3\nalpha 3\n"),
    ("{ c[$1] += $3 } END { for (k in c) print k, c[k] }", "alpha 8\ngamma 4\n"),
    ('/gamma/,/x/ { print NR ":" $2 }', "2:delta\n3:x\n"),
    ('NR==1 { next } { print; exit } END { print "bye" }', "gamma delta 4\nbye\n"),
    ('BEGIN { printf "%5.2f|%-4s|%x\\n", 3.14159, "ab", 255; print 7/2, 6/3, 2**10, 7%3, -7\\2 }', " 3.14|ab  |ff\n3.5 2 1024 1 -3\n"),
    ("function f(a, &b) { b = a * 2; return a + 1 } BEGIN { x = f(3, y); print x, y }", "4 6\n"),
    ('BEGIN { s = "tiger"; n = gsub(/[aeiou]/, "<&>", s); print n, s; print gensub(/o/, "0", 1, "foo boo"); print substr("hello", -1, 3), index("hello","l") }', "2 t<i>g<e>r\nf0o boo\nhel 3\n"),
    ('{ $2 = "Z"; $5 = "q"; print NF ":" $0 }', "5:alpha Z 3  q\n5:gamma Z 4  q\n5:alpha Z 5  q\n"),
    ("{ NF = 2; print }", "alpha beta\ngamma delta\nalpha x\n"),
    ('BEGIN { m["a"]["b"] = 1; m["a"]["c"] = 2; n = split("a:b:c", p, ":"); print n, p[2], ("b" in m["a"]); delete m["a"]["b"]; print length(m["a"]) }', "3 b 1\n1\n"),
    ("BEGIN { while (i < 5) { i++; if (i == 2) continue; if (i == 4) break; print i } do { i-- } while (i > 0); print i; for (j = 0; j < 2; j++) print j }", "1\n3\n0\n0\n1\n"),
    ('BEGIN { switch (3) { case 1: print "one"; case 3: print "three"; case 4: print "four"; break; default: print "none" } }', "three\nfour\n"),
    ('BEGIN { switch ("q") { default: print "none"; case 1: print "one" } }', "none\none\n"),
    ('BEGIN { if (match("foobar", /o+/, g)) print RSTART, RLENGTH, g[0]; print "9" < "100", 9 < 100, "a" ~ /[[:alpha:]]/ }', "2 2 oo\n0 1 1\n"),
    ("$3 > 10 { print $3 }", "3\n4\n5\n"),
    ("$3 + 0 > 3 { print $3 }", "4\n5\n"),
    ('BEGIN { a["x"]=3; a["y"]=1; n = asort(a); print n, a[1], a[2]; print 010 + 0, "0x1F" + 0, "3abc" + 1, -"-5" }', "2 1 3\n8 31 4 5\n"),
    ('{ while ((getline line < "side") > 0) print "side", line } END { print NR, (getline x < "none") }', "side l1\nside l2\n3 -1\n"),
    ('BEGIN { f = function(a) { return a * a }; print f(4); v = @{"k": 1, "j": @[1,2]}; print v.k, v["j"][2], length(v) }', "16\n1 2 2\n"),
    ("{ getline; print $1 }", "gamma\nalpha\n"),
    ("{ print 1e6, 0.1+0.2, 1/3; exit }", "1000000 0.3 0.333333\n"),
    ("{ nextfile; print }", ""),
    ('BEGIN { print 9223372036854775807 + 1; print !"0", !"", !0 }', "-9223372036854775808\n0 1 1\n"),
    ('END { print $0; print str::rindex("banana", "an"), str::trim("  x "), str::isdigit("12"), str::tohex("AB") }', "alpha x 5\n4 x 1 4142\n"),
    ("BEGIN { print 5 & 3, (5 | 3), 5 ^^ 3, 1 << 4, (16 >> 2), ~0 }", "1 7 6 16 4 -1\n"),
    ("BEGIN { x = 5; x **= 2; x %%= \"a\"; print x; print 1 === 1.0, 1 == 1.0; print 2 ** 3 ** 2, -2 ** 2 }", "25a\n0 1\n512 -4\n"),
]


@pytest.mark.parametrize("text,want", CASES)
def test_sequential(text, want):
    assert run(text) == want


@pytest.mark.parametrize("text", ["{ print", "BEGIN { x = }", "function { }", "{ a[1 }"])
def test_syntax_errors(text):
    with pytest.raises(SyntaxError):
        parse(text)


def test_number_fields():
    assert run("{ print $1 < $2, $1 }", ["9 100", "007 1.50", "08 7"], numstr=True) == "1 9\n0 7\n1 08\n"  # 08 is no number, so it is compared as text


PLANS = [
    ('BEGIN { OFS = ":" } /a/ { print $1, NF, NR * 2, $3 + 1; next } { print "rest" }', "rules"),
    ('$3 + 0 >= 4 { print toupper($1) "-" substr($2, 2), length($2) > "odd" }', "rules"),
    ("$1 == \"alpha\"", "rules"),
    ("{ c[$1]++; s[$1] += $3 } END { for (k in c) print k, c[k], s[k] / 2 }", "fold"),
    ("/a/ { n++ } $3 + 0 > 3 { t += $3 } END { print n, t }", "fold"),
    ("{ t += $3; print t }", "sequential"),
    ("NR == 2, NR == 3 { print }", "sequential"),
    ("function f(x) { return x 1 } { print f($1) }", "sequential"),
    ("{ seen[$1]++ } END { print NR }", "sequential"),
]


@pytest.mark.parametrize("text,kind", PLANS)
def test_plans_agree_with_the_interpreter(spark, text, kind):
    records = ["alpha beta 3", "gamma delta 4", "alpha x 5", "", "q  a  12 z", "no"]
    assert compile_program(text).kind == kind
    df = spark.createDataFrame(list(enumerate(records, 1)), "nr bigint, record string")
    got = [(r.dest, r.line) for r in sorted(run_program(text, df).collect(), key=lambda r: (r.nr or 0, r.at) if kind != "fold" else (0, 0))]
    want = [(d, x.removesuffix("\n")) for _, d, x in Interpreter(parse(text)).run(("", i, r) for i, r in enumerate(records, 1))]
    assert got == want


def test_domains_run_by_themselves(spark):
    df = spark.createDataFrame([(k, i, f"{k} {i}") for k in ("a", "b") for i in range(1, 4)], "k string, nr bigint, record string")
    got = run_program("{ t += $2 } END { print $1, t }", df, by=["k"]).collect()
    assert sorted((r.k, r.line) for r in got) == [("a", "a 6"), ("b", "b 6")]


@pytest.mark.parametrize("text", [c[0] for c in CASES] + [p[0] for p in PLANS])
def test_printed_programs_do_the_same(text):
    from recordflow.plans import printer

    once = printer.program(parse(text))
    assert run(once) == run(text) and printer.program(parse(once)) == once


INCLUDES = {"lib": 'function twice(x) { return x * 2 }\n@global held = 5;\nBEGIN { print "begun" }', "both": '@include_once "lib"; @include_once "lib"; function more(x) { return twice(x) + held }', "self": '@include "self"'}

PROGRAMS = [
    ('@pragma entry main\n@include "lib";\nBEGIN { print "not run" }\nfunction main() { print twice(4), held }\n{ print "nor this" }', "8 5\n"),
    ('@include "both"\nEND { print more(1), NR }', "begun\n7 3\n"),
    ("@pragma entry main\nfunction main() { while ((getline line) > 0) n++; print n, $1 }", "3 alpha\n"),
    ("@pragma implicit off\n@global total;\n{ @local x; x = $3; total += x } END { print total }", "12\n"),
    ('BEGIN { print strftime("%Y-%m-%d", 86400), mktime("1970 1 2 0 0 0"), sys::mktime("2000 14 1 0 0 0"), mktime("1970") }', "1970-01-02 86400 980985600 -1\n"),
    ('BEGIN { print str::tobase64("hi"), str::frombase64("aGk="), str::frombcharcode(72, 105), hawk::typename(str::tombs("é")), length(str::tombs("é")), str::frommbs(str::tombs("é")) }', "aGk= hi Hi mbs 2 é\n"),
    ('BEGIN { x = @b"a\\xffb"; print hawk::typename(x), length(x), hawk::type(x), hawk::type(1), hawk::type(1.5), hawk::type(""), hawk::type(nothing) }', "mbs 3 7 4 5 6 0\n"),
    ('BEGIN { print hawk::cmgr_exists("utf-8"), hawk::cmgr_exists("none"), hawk::hash("a") == hawk::hash("a"), hawk::function_exists("json::parse"), length(hawk::modlibdirs()) }', "1 0 1 1 0\n"),
    ('BEGIN { v = json::parse("{\\"a\\": [1, {\\"b\\": null}], \\"c\\": -12.5, \\"d\\": true}"); print v["a"][1], v.c, hawk::typename(v.d); print json::stringify(v) }', '1 -12.5 bool\n{"a":[1,{"b":null}],"c":-12.5,"d":true}\n'),
    ('BEGIN { print sed::str_to_str("s/a/b/", "banana", x), x; print sed::str_to_str("}", "a", x) }', "0 bbnana\n-1\n"),
    ('BEGIN { print sys::unpack("<hq", sys::pack("<hq", 7, -2), a), a[1], a[2] }', "2 7 -2\n"),
    ('{ n = (getbline b < "side"); print n, hawk::typename(b), length(b); exit }', "1 mbs 2\n"),
    ('BEGIN { print setioattr("bytes", "codepage", "latin1"), setioattr("x", "codepage", "none"); getioattr("bytes", "codepage", cs); getline line < "bytes"; print cs, line, getioattr("y", "codepage", cs) }', "0 -1\nlatin1 é -1\n"),
    ('BEGIN { print sys::getenv("HAWK_NO_SUCH_NAME") "." }', ".\n"),
]


@pytest.mark.parametrize("text,want", PROGRAMS)
def test_modules_and_pragmas(text, want):
    out = Interpreter(parse(text, INCLUDES), files={"side": "l1\nl2\n", "bytes": b"\xe9\n"}).run(("f", i, r) for i, r in enumerate(RECORDS, 1))
    assert "".join(x for _, _, x in out) == want


@pytest.mark.parametrize("text", ['@include "none"', '@include "self"', "@pragma entry none", "@pragma entry a\n@pragma entry b\nfunction a() {} function b() {}", "@pragma implicit off\n{ x = 1 }", "@pragma implicit maybe", "@include x"])
def test_wrong_units(text):
    with pytest.raises(SyntaxError):
        parse(text, INCLUDES)


@pytest.mark.parametrize("text", ['{ print | "sort" }', '{ print |& "sort" }'])
def test_pipes_are_refused_aloud(spark, text):
    with pytest.raises(PermissionError, match="sort"):
        run(text)
    df = spark.createDataFrame([(1, "a")], "nr bigint, record string")
    with pytest.raises(Exception, match="PermissionError"):
        run_program(text, df).collect()


def test_console_outputs(spark):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(RECORDS, 1)], "nr bigint, record string")
    text = '{ print $2; nextofile; if (NR == 2) print "side" > "side" }'
    got = run_program(text, df, outputs=("one", "two")).collect()
    assert [(r.dest, r.line) for r in got] == [("one", "beta"), ("two", "delta"), ("side", "side"), ("two", "x")]
    assert [r.dest for r in run_program("{ print; nextofile }", df).collect()] == [None] * 3


def test_domains_are_streams(spark):
    """Each domain by itself, in order, also where its key is null; state doesn't go from one to the next."""
    rows = [(k, i, f"{i}", "x") for i in range(400) for k in (None, "a", "b")]
    df = spark.createDataFrame(rows, "k string, nr bigint, record string, __file string").repartition(5)
    got = run_program("{ s += $1; n++ } n % 100 == 0 { print n, s } END { print \"end\", FILENAME }", df, by=["k"]).collect()
    for k in (None, "a", "b"):
        mine = sorted((r.nr, r.at, r.line) for r in got if r.k == k)
        assert [x for _, _, x in mine] == [f"{n} {sum(range(n))}" for n in (100, 200, 300, 400)] + ["end "]
    files = df.select(df.k.alias("file"), "nr", "record").where("k is not null")
    got = run_program("NR == 1 { print FILENAME, FNR } { seen = 1 }", files, by=["file"]).collect()
    assert {(r.file, r.line) for r in got} == {("a", "a 0"), ("b", "b 0")}
    assert execute("{ n++ } END { print n }", ["x", "y"]) == "2\n" and execute('@include "lib"\n', includes=INCLUDES) == "begun\n"


def test_host_functions(spark):
    @stores(1)
    def halves(x, out):
        out.set(x / 2)
        return len(str(x))

    host = {"halves": halves, "my::join": lambda *a: "+".join(map(str, a))}
    assert execute('BEGIN { n = halves(9, h); print n, h, my::join(1, "b"); m["k"] = 0; halves(4, m["k"]); print m["k"], hawk::function_exists("halves") }', host=host) == "1 4.5 1+b\n2 1\n"
    df = spark.createDataFrame([(1, "a"), (2, "b")], "nr bigint, record string")
    assert [r.line for r in run_program("{ print my::join($1, NR) }", df, host=host).orderBy("nr").collect()] == ["a+1", "b+2"]


def test_database_from_a_program(tmp_path):
    text = r"""
    @pragma entry main
    @pragma implicit off
    function main() {
        @local db, st, row, out;
        db = sqlite::open();
        print sqlite::exec(db, "select 1"), sqlite::connect(db, path()), sqlite::exec(db, "create table t(id integer primary key, name text, score real, raw blob)");
        st = sqlite::prepare(db, "insert into t(name, score, raw) values (?, ?, ?)");
        print sqlite::bind_str(st, 1, "alice"), sqlite::bind_flt(st, 2, 1.5), sqlite::bind_blob(st, 3, @b"\x01\x02"), sqlite::fetch_row(st, row), sqlite::changes(db), sqlite::last_insert_rowid(db);
        sqlite::reset(st); sqlite::bind(st, 1, "bob's"); sqlite::bind_int(st, 2, 2); sqlite::bind_null(st, 3);
        print sqlite::fetch_row(st, row), sqlite::last_insert_rowid(db), sqlite::finalize(st), sqlite::finalize(st);
        st = sqlite::prepare(db, "select id, name, score, raw from t where score > ? order by id");
        sqlite::bind(st, 1, 1);
        print sqlite::column_count(st), sqlite::column_name(st, 2), sqlite::column_name(st, 9);
        while (sqlite::fetch_row(st, row) > 0) print row["1"], row["2"], row["3"], hawk::typename(row["3"]), hawk::typename(row["4"]);
        print sqlite::escape_string(db, "it's", out), out;
        print sqlite::prepare(db, "select nothing from nowhere"), (length(sqlite::errmsg()) > 0), sqlite::close(db), sqlite::exec(db, "select 1");
    }"""
    got = execute(text, host=sqlite_module() | {"path": lambda: str(tmp_path / "x.db")})
    assert got.splitlines() == ["-1 0 0", "0 0 0 0 1 1", "0 2 0 -1", "4 name -1", "1 alice 1.5 flt mbs", "2 bob's 2 flt nil", "0 it''s", "-1 1 0 -1"]


CONTROL = """
function f(x, n) { while (1) { if (x > n) return x + 1; x++ } }
{ s = i = 0
  while (i < 3) { i++; if (i == 2) continue; s += $1 * i }
  for (j = 0; ; j++) { if (j > 1) break; s += j }
  do s--; while (s % 5 != 0)
  switch ($2) { case "a": k = "A"; break; case "b": k = "B"; default: k = k "o" }
  if (!(NR in seen)) seen[NR] = 1; else print "again"
  m[$2]++; m[$2, s > 9] += s / 4; for (x in m) if (x == "b") break
  print $1, f(s, 3) k x, $2 == "a" ? -s : s "", length(seen); delete seen }
END { for (x in m) print x, m[x] }"""


def test_programs_are_put_together_once(monkeypatch):
    """The same output as the interpreter gives node by node, without looking up the nodes of each record."""
    from recordflow.plans import compiled

    records, calls, ev = [f"{i} {'abc'[i % 3]}" for i in range(50)], [], Interpreter.ev
    monkeypatch.setattr(Interpreter, "ev", lambda s, e: calls.append(e[0]) or ev(s, e))
    rows = lambda: (("", i, r) for i, r in enumerate(records, 1))
    got = list(Interpreter(parse(CONTROL)).run(rows()))
    assert len(calls) <= 3 * len(records)  # length() and the minus

    monkeypatch.setattr(compiled.Code, "do", lambda _, n: lambda s: s.do(n))
    monkeypatch.setattr(compiled.Code, "ev", lambda _, n: lambda s: s.ev(n))
    calls.clear()
    assert list(Interpreter(parse(CONTROL)).run(rows())) == got and len(got) >= 50 and len(calls) > 50 * len(records)


def test_domains_of_few_bytes_are_dealt_to_all_tasks(spark):
    rows = spark.range(400).selectExpr("id % 40 as k", "id as nr", "cast(id as string) as record")
    out = run_program("{ n++; print n, $1 }", rows, by=["k"])
    assert out.rdd.getNumPartitions() == 4 and out.count() == 400


def test_fold_computes_conditions_once(spark):
    """A condition's rule for numbers stands in the plan once, however many sums and filters it decides about."""
    recs = spark.createDataFrame([(i, f"{'ab'[i % 2]} {v} {i}") for i, v in enumerate(["1", "+2", "-0x1F", "010", " 3e1", "x", "1.50", ""])], "nr bigint, record string")
    text = "$2 + 0 > 1 { n[$1]++; q[$1] += $3; r[$1] += 2 } END { for (f in n) print f, n[f], q[f], r[f] }"
    got = run_program(text, recs)
    assert compile_program(text).kind == "fold" and got._jdf.queryExecution().optimizedPlan().toString().count("[xX]([0-9a-fA-F]+)") <= 2  # the condition's and $3's
    rows = [(r.nr, r.record) for r in recs.collect()]
    want = "".join(x for _, _, x in Interpreter(parse(text)).run(("", n, r) for n, r in rows))
    assert sorted(r.line for r in got.collect()) == sorted(want.splitlines()) and want
