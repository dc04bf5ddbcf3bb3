"""Names, options, exports, datasets, sources and streams."""

import keyword
import subprocess
import sys
from pathlib import Path

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import verbena
from verbena import arg_match, datasets
from verbena.all import c, cumsum, f, factor, filter_, group_by, group_split, lag, mean, min_rank, mutate, n, pivot_wider, row_number, select, sum_, summarise, tibble
from verbena.names import NameNonUniqueError, make_names, make_unique, repair_names
from verbena.options import add_option, get_option, options, options_context
from verbena.sources import read, sql, write


# ---------------------------------------------------------------- names
MESSY = st.lists(st.one_of(st.none(), st.just(float("nan")), st.integers(-3, 40), st.text("ab_ .:9é", max_size=5), st.sampled_from(["class", "km/h", "tempo__3", "__7", "ruote__1__2"])), min_size=1, max_size=9)


@given(MESSY)
@settings(max_examples=200, deadline=None)
def test_names_are_text_and_repair_is_stable(names):
    for kind in ("minimal", "unique", "universal"):
        out = repair_names(names, kind)
        assert len(out) == len(names) and all(isinstance(x, str) for x in out)
        assert kind == "universal" or repair_names(out, kind) == out


@given(MESSY)
@settings(max_examples=200, deadline=None)
def test_unique_names_tell_their_place(names):
    out = repair_names(names, "unique")
    assert len(set(out)) == len(out) and "" not in out
    for i, x in enumerate(out):
        stem, mark, place = x.rpartition("__")
        assert not mark or not place.isdigit() or int(place) == i


@given(MESSY)
@settings(max_examples=200, deadline=None)
def test_universal_names_are_identifiers(names):
    for x in repair_names(names, "universal"):
        assert (x.isidentifier() and not keyword.iskeyword(x)) or x.startswith("_")


@given(st.lists(st.text("abcxyz", min_size=1, max_size=4), unique=True, min_size=1, max_size=6))
def test_good_names_stay(names):
    names = [x for x in names if not keyword.iskeyword(x)] or ["q"]
    for kind in ("minimal", "unique", "universal", "check_unique"):
        assert repair_names(names, kind) == names


def test_repair_by_hand():
    assert repair_names(["giro", None, "giro"], "unique") == ["giro__0", "__1", "giro__2"]
    assert repair_names(["km/h", "while", 5], "universal") == ["km_h", "_while", "_5"]

    def numbered(names: list):
        return [f"{x}{k}" for k, x in enumerate(names)]

    assert repair_names(["p", "q"], numbered) == ["p0", "q1"]
    assert repair_names(["p", "q"], str.title) == ["P", "Q"] and repair_names(["p", "q"], ["u", "v"]) == ["u", "v"]
    assert make_names("km/h") == ["km_h"] and make_unique(["u", "v", "u"]) == ["u__0", "v", "u__2"]
    with pytest.raises(ValueError):
        repair_names(["p"], 3.5)


@pytest.mark.parametrize("bad", [["u", "u"], [None], ["ok", ""], ["x", "__4"]])
def test_names_that_are_refused(bad):
    with pytest.raises(NameNonUniqueError):
        repair_names(bad, "check_unique")


# ---------------------------------------------------------------- options
def test_options():
    add_option("colour.depth", 8)
    before = options("colour_depth")
    assert before["colour_depth"] == get_option("colour.depth") == 8
    with options_context(colour_depth=24, nan_is_na=True):
        assert (get_option("colour_depth"), get_option("nan.is.na")) == (24, True)
        assert options({"colour.depth": 32}, _return=True).colour_depth == 24
    assert (get_option("colour_depth"), get_option("nan_is_na")) == (8, False)
    assert get_option("no_such_option", "else") == "else" and "colour_depth" in options()


@pytest.mark.parametrize("module,name", [("all", "sum"), ("all", "slice"), ("base", "sum"), ("dplyr", "filter")])
def test_conflicting_names(module, name):
    here = Path(__file__).parent.parent
    ok = f"import verbena.{module} as m; assert m.{name} is m.{name}_ and getattr(m, '{name}')"
    bad = f"from verbena.{module} import {name}"
    allowed = f"from verbena import options; options(allow_conflict_names=True); from verbena.{module} import {name}"
    for code, works in ((ok, True), (bad, False), (allowed, True)):
        assert (subprocess.run([sys.executable, "-c", code], cwd=here, capture_output=True).returncode == 0) is works


def test_small_things(capsys):
    assert arg_match("a", "arg", ["a", "b"]) == "a"
    with pytest.raises(ValueError):
        arg_match("z", "arg", ["a"])
    assert "pyspark" in verbena.get_versions(prnt=False)
    verbena.get_versions()
    assert "verbena" in capsys.readouterr().out
    assert "iris" in datasets.descr_datasets() and len(datasets.registry) >= 52
    with pytest.raises(ValueError):
        datasets.load_dataset("nothing")


def test_sources(spark, tmp_path):
    x = tibble(a=[3, 1, 2], b=["x", None, "z"])
    for end in ("parquet", "orc", "csv", "json"):
        path = str(tmp_path / f"t.{end}")
        write(x, path)
        assert sorted(read(path).to_dict()["a"]) == [1, 2, 3]
    back = read(str(tmp_path / "t.parquet"), keep_order=True)
    assert sorted((back >> mutate(s=f.a * 2)).to_dict()["s"]) == [2, 4, 6]
    assert sql("select sum(a) as s from t", t=x).collect() == [(6,)]
    datasets.add_dataset("three", datasets.Metadata(source=str(tmp_path / "t.parquet")))
    assert datasets.three.columns == ["a", "b"]


def test_filters_reach_the_files(spark, tmp_path):
    path = str(tmp_path / "p.parquet")
    write(tibble(a=[1, 2, 3], b=[1, 2, 3], d=["x", "y", "z"]), path)
    out = read(path) >> filter_(f.a > 1) >> group_by(f.d) >> summarise(s=sum_(f.b), k=n(), _groups="drop")
    plan = out.df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(a,1)" in plan and "Python" not in plan and "CartesianProduct" not in plan


def test_stream(spark, tmp_path):
    from verbena.streaming import read_stream, time_window, watermark, write_stream

    folder = str(tmp_path / "in.parquet")
    spark.sql("select timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,id) as ts, id % 2 as k, id as v from range(10)").write.parquet(folder)
    stream = read_stream(folder, "ts timestamp, k bigint, v bigint") >> filter_(f.v > 1) >> mutate(w=f.v * 10)
    counted = time_window(watermark(stream, "ts", "1 minute") >> group_by(f.k), "ts", "1 hour") >> summarise(s=sum_(f.w, na_rm=True), _groups="drop")
    run = write_stream(counted >> select(f.k, f.s), format="memory", name="sums", mode="complete", available_now=True)
    run.awaitTermination(120)
    assert sorted(map(tuple, spark.sql("select k, s from sums").collect())) == [(0, 200), (1, 240)]


def test_own_functions_and_verbs(spark):
    @verbena.register_func()
    def plus_one(x):
        return x + 1

    @verbena.register_verb
    def doubled(frame, column):
        return frame >> mutate(d=column * 2)

    x = tibble(a=[1, 2])
    assert (x >> mutate(b=plus_one(f.a))).collect() == [(1, 2), (2, 3)]
    assert (x >> doubled(f.a)).collect() == [(1, 2), (2, 4)]
    assert ([1, 2, 3] >> mean()) == 2.0


def test_no_window_over_all_rows(spark):
    x = tibble(a=[1.0, 2.0, 3.0])
    out = x >> mutate(s=f.a / sum_(f.a), k=n()) >> filter_(f.a > mean(f.a))
    plan = out.df._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan
    assert out.collect() == [(3.0, 0.5, 3)]


def test_nan_option(spark):
    x = tibble(a=[1.0]) >> mutate(b=f.a * float("inf") - float("inf"))
    with options_context(nan_is_na=True):
        assert (x >> summarise(m=mean(f.b, na_rm=True))).collect() == [(None,)]
    assert list(c[0:2]) == [0, 1]


def test_window_functions_refuse_streams(spark, tmp_path):
    from verbena.streaming import read_stream

    folder = str(tmp_path / "in.parquet")
    spark.range(3).selectExpr("id as v").write.parquet(folder)
    stream = read_stream(folder, "v bigint")
    for make in (lambda: cumsum(f.v), lambda: lag(f.v), lambda: row_number(f.v), lambda: min_rank(f.v)):
        with pytest.raises(ValueError):
            stream >> mutate(x=make())


def test_limits_on_the_driver(spark):
    x = tibble(g=["a", "b", "c"], v=[1, 2, 3])
    with options_context(max_levels=2, max_groups=2):
        with pytest.raises(ValueError, match="max_levels"):
            x >> mutate(k=factor(f.g))
        with pytest.raises(ValueError, match="max_levels"):
            x >> pivot_wider(names_from=f.g, values_from=f.v)
        with pytest.raises(ValueError, match="max_groups"):
            x >> group_by(f.g) >> group_split()
