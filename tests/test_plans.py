import pytest

from quire import runtime
from quire.functions import layout as L
from quire.functions import scalars as S
from quire.operators import styles
from quire.plans import naming


def test_flags_and_config(tmp_path):
    for bad in ({"overwrite": True, "auto_rename": True}, {"output": "a", "output_dir": "b"}, {"font_size": 99}, {"jobs": 0}):
        with pytest.raises(ValueError):
            naming.check_flags(bad)
    naming.check_flags({"font_size": 12})
    assert naming.load_config(str(tmp_path / "none.yaml")) == (naming.DEFAULTS, None)
    (tmp_path / "c.yaml").write_text("font_size: 12\njustify: false\n")
    got, error = naming.load_config(str(tmp_path / "c.yaml"))
    assert error is None and got == naming.DEFAULTS | {"font_size": 12, "justify": False}
    o = naming.options_for("compact", config=got)
    assert o.font_size == 12 and not o.justify
    (tmp_path / "d.yaml").write_text("a: [\n")
    assert naming.load_config(str(tmp_path / "d.yaml"))[1]


@pytest.mark.parametrize("name, want", [("", (612.0, 792.0)), ("A5", (419.53, 595.28)), ("6x9in", (432.0, 648.0)), ("100x200pt", (100.0, 200.0)), ("25.4x50.8", (72.0, 144.0)), ("x", None), ("0x5mm", None)])
def test_page_sizes(spark, name, want):
    from pyspark.sql import functions as F

    r = spark.createDataFrame([(name,)], "n string").select(L.page_size(F.col("n"), 0).alias("w"), L.page_size(F.col("n"), 1).alias("h")).first()
    assert (r["w"], r["h"]) == pytest.approx(want) if want else r["w"] is None
    if want:
        assert naming.page_size(name) == pytest.approx(want)
    else:
        with pytest.raises(ValueError):
            naming.page_size(name)


@pytest.mark.parametrize("value", ["1.2em", "80%", "0%", "14pt", "-3px", "small", "XX-LARGE", "x", "1d", "0", "2rem", "1e1px", ""])
def test_sizes_agree(spark, value):
    """The expressions agree with the kernel's functions."""
    from pyspark.sql import functions as F

    r = spark.createDataFrame([(value,)], "v string").select(L.css_size(F.col("v")).alias("s"), L.css_length(F.col("v")).alias("l")).first()
    assert r["s"] == pytest.approx(styles.size(value.lower())) if styles.size(value.lower()) is not None else r["s"] is None
    assert r["l"] == pytest.approx(styles.length(value.lower())) if styles.length(value.lower()) is not None else r["l"] is None


def test_scalars(spark):
    from pyspark.sql import functions as F

    row = spark.createDataFrame([("a bb ccc dddd", 3_221_225_472, 65_000)], "t string, b long, ms long").select(
        S.wrapped(F.col("t"), 6).alias("w"), S.format_bytes(F.col("b")).alias("b"), S.format_duration(F.col("ms")).alias("d"), S.ellipsis(F.col("t"), 5, True).alias("e"), S.points(F.lit(450.0)).alias("p"), S.points(F.lit(0.5)).alias("q"),
        S.wrap_index(F.lit(-1), F.lit(5)).alias("i"), S.yes_no(F.lit(True)).alias("y"), S.has_style(F.lit(5), 4).alias("h"),
    ).first()
    assert tuple(row) == ("a bb\nccc\ndddd", "3.00 GB", "1m 05s", "a bb…", "450", "0.5", 4, "yes", True)


def test_broadcast_only_after_a_count(spark):
    small, large = spark.range(5), spark.range(50)
    plan = lambda df: spark.range(9).join(df, "id")._jdf.queryExecution().toString()
    assert "BroadcastHashJoin" in plan(runtime.small_or_shuffled(small, 10)) and "SortMergeJoin" in plan(runtime.small_or_shuffled(large, 10))
    wide = small.selectExpr("id", "repeat('é', 100) as t", "array('x') as a")
    assert "SortMergeJoin" in plan(runtime.small_or_shuffled(wide, 10, size=1000)) and "BroadcastHashJoin" in plan(runtime.small_or_shuffled(wide, 10, size=2000))
    with pytest.raises(ValueError):
        runtime.collect_bounded(large, 10, "rows")
    assert runtime.spread(spark.range(3).coalesce(1)).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_places_within_groups(spark):
    df = spark.range(300).selectExpr("id", "cast(if(id % 3 = 0, null, id % 2) as int) as g", "hash(id) as k")
    got = {(r["g"], r["id"]): r["place"] for r in runtime.ranked(df, "g", ["k", "id"], "place").collect()}
    rows = sorted(df.collect(), key=lambda r: (r["k"], r["id"]))
    want = {}
    for g in (None, 0, 1):
        want |= {(g, r["id"]): n for n, r in enumerate((r for r in rows if r["g"] == g), 1)}
    assert got == want


def test_a_cluster_needs_a_shared_folder(spark):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return {}

    class Frame:
        class sparkSession:  # noqa: N801
            conf, sparkContext = {}, Context()

    with pytest.raises(ValueError, match="checkpoint"):
        runtime.checkpointed(Frame())
