"""Edit chains: reference options, their ten edits, and how far a model's chain keeps up."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The five base charts, as (name, type, data) of their series.
VARIANTS = (
    (("Revenue", "bar", (120, 132, 101, 134, 90, 230)), ("Target", "bar", (110, 120, 115, 140, 100, 210))),
    (("North", "line", (32, 45, 41, 53, 49, 60)), ("South", "line", (28, 35, 39, 47, 43, 55))),
    (("Orders", "bar", (22, 18, 29, 31, 24, 36)), ("Conversion", "line", (12, 14, 15, 18, 17, 22))),
    (("Desktop", "bar", (52, 61, 58, 63, 70, 74)), ("Mobile", "bar", (45, 49, 51, 57, 64, 68)), ("Tablet", "bar", (12, 14, 13, 15, 17, 18))),
    (("Visits", "line", (220, 210, 260, 280, 310, 305)), ("Qualified", "line", (90, 94, 110, 128, 140, 145)), ("Won", "line", (32, 34, 39, 43, 47, 52))),
)
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun")
#: Fields of the signature in the order in which the steps make them count; the tenth step adds none.
FIELDS = ("title_text", "legend_pos", "background", "labels_signature", "palette", "splitline", "grid", "series_style", "title_layout")
REPORTED_STEPS = (1, 3, 5, 8, 10)


def active_count(step: Column) -> Column:
    return F.least(step, F.lit(len(FIELDS))).cast("long")


def _value(v) -> Column:
    """A position, which may be a number or a word: a variant."""
    return F.lit(None).cast("variant") if v is None else F.parse_json(F.lit(json.dumps(v)))


def base_options(charts: DataFrame, id_col: str = "chart_id") -> DataFrame:
    """(chart_id, option): one of five base charts by the id's remainder. A field that a chart doesn't set is null."""

    def series(name, kind, data):
        bar = kind == "bar"
        item = F.struct(F.array(*[F.lit(0)] * 4).alias("borderRadius")) if bar else F.lit(None).cast("struct<borderRadius:array<int>>")
        line = F.struct(F.lit(2).alias("width")) if not bar else F.lit(None).cast("struct<width:int>")
        return F.struct(
            F.lit(name).alias("name"), F.lit(kind).alias("type"), F.array(*map(F.lit, data)).alias("data"), F.struct(F.lit(False).alias("show"), F.lit("top").alias("position")).alias("label"),
            item.alias("itemStyle"), F.lit(22 if bar else None).cast("int").alias("barWidth"), line.alias("lineStyle"), F.lit(None if bar else "circle").cast("string").alias("symbol"), F.lit(None if bar else 6).cast("int").alias("symbolSize"),
        )

    chosen = reduce(lambda rest, k: F.when(F.col(id_col) % len(VARIANTS) == k, F.array(*[series(*s) for s in VARIANTS[k]])).otherwise(rest), range(len(VARIANTS)), F.lit(None))
    none = lambda kind: F.lit(None).cast(kind)
    option = F.struct(
        F.struct(F.concat(F.lit("Base Chart "), (F.col(id_col) + 1).cast("string")).alias("text"), _value("center").alias("left"), _value(8).alias("top"), none("struct<color:string>").alias("textStyle")).alias("title"),
        F.struct(F.lit("axis").alias("trigger")).alias("tooltip"),
        F.struct(_value(8).alias("top"), _value("center").alias("left"), none("int").alias("bottom"), none("int").alias("right"), none("string").alias("orient")).alias("legend"),
        F.struct(F.lit(50).alias("left"), F.lit(30).alias("right"), F.lit(55).alias("top"), F.lit(40).alias("bottom")).alias("grid"),
        F.struct(F.lit("category").alias("type"), F.array(*map(F.lit, MONTHS)).alias("data")).alias("xAxis"),
        F.struct(F.lit("value").alias("type"), F.struct(F.lit(False).alias("show"), none("struct<type:string,color:string>").alias("lineStyle")).alias("splitLine")).alias("yAxis"),
        none("string").alias("backgroundColor"),
        none("array<string>").alias("color"),
        chosen.alias("series"),
    )
    return charts.select(id_col, option.alias("option"))


def _each(option: Column, change) -> Column:
    return option.withField("series", F.transform(option["series"], change))


# What each of the ten edits sets (None: takes away).
EDITS = {
    1: {"title.text": "Quarterly Review Dashboard", "title.left": "center", "title.top": 10},
    2: {"legend.bottom": 10, "legend.left": "center", "legend.orient": "horizontal", "legend.right": None, "legend.top": None},
    3: {"backgroundColor": "#f7f7fb"},
    5: {"color": ["#2456A6", "#2F8F6B", "#D9822B"]},
    6: {"yAxis.splitLine.show": True},
    7: {"grid.left": 70, "grid.right": 50, "grid.top": 80, "grid.bottom": 70},
    9: {"title.left": 30, "title.top": 10},
    10: {"legend.left": None, "legend.bottom": None, "legend.right": 12, "legend.top": "middle", "legend.orient": "vertical"},
}
#: Fields that hold numbers or words.
_VARIANTS = ("title.left", "title.top", "legend.left", "legend.top")


def apply_edit_step(option: Column, step: int) -> Column:
    """The option after one of the ten edits."""
    for path, value in EDITS.get(step, {}).items():
        new = _value(value) if path in _VARIANTS else F.array(*map(F.lit, value)) if isinstance(value, list) else F.lit(value).cast("int") if value is None else F.lit(value)
        option = option.withField(path, new)
    if step == 4:
        option = _each(option, lambda s: s.withField("label", F.struct(F.lit(True).alias("show"), F.lit("top").alias("position"))))
    if step == 6:
        option = option.withField("yAxis.splitLine.lineStyle", F.struct(F.lit("dashed").alias("type"), F.lit("#d0d7e2").alias("color")))
    if step == 8:
        bar = lambda s: s.withField("itemStyle", F.struct(F.array(*map(F.lit, (6, 6, 0, 0))).alias("borderRadius")))
        line = lambda s: s.withField("lineStyle", F.struct(F.lit(3).alias("width"))).withField("symbolSize", F.lit(10))
        option = _each(option, lambda s: F.when(s["type"] == "bar", bar(s)).when(s["type"] == "line", line(s)).otherwise(s))
    if step == 9:
        option = option.withField("title.textStyle", F.struct(F.lit("#16324f").alias("color")))
    return option


def chain_options(options: DataFrame, steps: int = 10, id_col: str = "chart_id", text: bool = True) -> DataFrame:
    """(chart_id, step, option): each step's reference option; step 0 is the base. As JSON text, or else as the struct it is."""
    if text:  # a list of all steps' texts for each chart: a plan has the edits once, not again for each step
        df = options.select(id_col, F.col("option").alias("_0"))
        for k in range(1, steps + 1):
            df = df.withColumn(f"_{k}", apply_edit_step(F.col(f"_{k - 1}"), k))
        texts = df.select(id_col, F.posexplode(F.array(*[F.to_json(f"_{k}") for k in range(steps + 1)])).alias("step", "option"))
        return texts.withColumn("step", F.col("step").cast("long"))
    out, df = [], options
    for k in range(steps + 1):
        if k:
            df = df.withColumn("option", apply_edit_step(F.col("option"), k))
        out.append(df.select(id_col, F.lit(k).cast("long").alias("step"), "option"))
    return reduce(DataFrame.unionByName, out)


#: Parts of an option that its signature is made of.
_PARTS = ("title", "legend", "backgroundColor", "color", "yAxis", "grid", "series")


def _node(v: Column, path: str, kind: str = "string") -> Column:
    """A value whose first node may be an object or a list of one object."""
    head, _, rest = path.partition(".")
    rest = f".{rest}" if rest else ""
    return F.coalesce(F.try_variant_get(v, f"$.{head}[0]{rest}", kind), F.try_variant_get(v, f"$.{head}{rest}", kind))


def semantic_signature(options: DataFrame, option: str = "option") -> DataFrame:
    """Add the nine comparable fields of an option, each as one text; null where nothing is set.

    The option is JSON text, or a struct of the same fields, where null is the same as absent. Of a struct only the parts that wanted fields need are looked at.
    """
    # a text is parsed once, and its series are taken out once: columns of their own, which Spark doesn't put in everywhere they are used
    kind = "struct<name:string,type:string,label:struct<show:boolean,position:string>,itemStyle:struct<borderRadius:string>,barWidth:string,lineStyle:struct<width:string>,symbolSize:string>"
    given = options.schema[option].dataType
    if isinstance(given, T.StructType):
        part = lambda t: F.to_variant_object(F.struct(F.col(option)[t].alias(t))) if t in given.names else F.lit(None).cast("variant")
        parsed = options.withColumns({f"_v_{t}": part(t) for t in _PARTS})
        v = {t: F.col(f"_v_{t}") for t in _PARTS}
    else:
        parsed = options.withColumn("_v", F.try_parse_json(option))
        v = dict.fromkeys(_PARTS, F.col("_v"))
    one = F.try_variant_get(v["series"], "$.series", kind)  # a list of one may stand without its brackets
    parsed = parsed.withColumn("_series", F.coalesce(F.try_variant_get(v["series"], "$.series", f"array<{kind}>"), F.when(one.isNotNull(), F.array(one))))
    series = F.col("_series")
    text = lambda *parts: F.concat_ws("|", *[F.coalesce(p, F.lit("-")) for p in parts])
    flag = lambda c: F.coalesce(c.cast("string"), F.lit("false"))
    labels = F.transform(series, lambda s: text(s["type"], flag(s["label"]["show"]), s["label"]["position"]))
    bars = F.transform(F.filter(series, lambda s: s["type"] == "bar"), lambda s: text(s["name"], s["itemStyle"]["borderRadius"], s["barWidth"]))
    lines = F.transform(F.filter(series, lambda s: s["type"] == "line"), lambda s: text(s["name"], s["lineStyle"]["width"], s["symbolSize"]))
    n = lambda path: _node(v[path.partition(".")[0]], path)
    found = {
        "title_text": n("title.text"),
        "title_layout": text(n("title.left"), n("title.top"), n("title.textStyle.color")),
        "legend_pos": text(n("legend.left"), n("legend.bottom").isNotNull().cast("string"), n("legend.right").isNotNull().cast("string"), n("legend.top"), n("legend.orient")),
        "background": F.try_variant_get(v["backgroundColor"], "$.backgroundColor", "string"),
        "labels_signature": F.array_join(labels, ";"),
        "palette": F.try_variant_get(v["color"], "$.color", "string"),
        "splitline": text(flag(n("yAxis.splitLine.show")), n("yAxis.splitLine.lineStyle.type"), n("yAxis.splitLine.lineStyle.color")),
        "grid": text(n("grid.left"), n("grid.right"), n("grid.top"), n("grid.bottom")),
        "series_style": F.concat(F.array_join(bars, ";"), F.lit("/"), F.array_join(lines, ";")),
    }
    return parsed.withColumns(found).drop("_v", "_series", *[f"_v_{t}" for t in _PARTS])


def usable_series(options: DataFrame, option: str = "option", state: Column | None = None) -> DataFrame:
    """Add `usable_series`: the place of the series with most data, the first of equals; for a state, of the first series longer than it. -1 if none."""
    sizes = F.transform(F.from_json(F.get_json_object(option, "$.series"), "array<struct<data:array<string>>>"), lambda s: F.coalesce(F.size(s["data"]), F.lit(0)))
    if state is None:
        at = F.array_position(sizes, F.array_max(sizes)) - 1
    else:
        at = F.array_position(F.transform(sizes, lambda n: n > state), True) - 1
    return options.withColumn("usable_series", F.coalesce(at, F.lit(-1)).cast("long"))


def field_fidelity(ref: DataFrame, gen: DataFrame, keys: tuple[str, ...] = ("chart_id", "step"), how: str = "inner", more: tuple[str, ...] = ()) -> DataFrame:
    """(chart_id, step, field_fidelity, exact_match): the share of the step's active fields that agree; two absent ones do. Columns `more` of `gen` follow.

    With `how` left, a step that `gen` lacks is compared with one that sets no field.
    """
    # Steps are so alike that their files are a small part of what their rows take in memory: by file sizes Spark would gather them all on the driver, to broadcast them.
    renamed = gen.select(*keys, *more, *[F.col(f).alias(f"_{f}") for f in FIELDS]).hint("merge")
    both = ref.select(*keys, *FIELDS).where("step > 0").join(renamed, list(keys), how).withColumn("_n", active_count(F.col("step")))
    same = reduce(lambda a, b: a + b, [F.when((F.col("_n") >= k + 1) & F.col(f).eqNullSafe(F.col(f"_{f}")), 1).otherwise(0) for k, f in enumerate(FIELDS)])
    return both.select(*keys, F.round(same / F.col("_n"), 4).alias("field_fidelity"), (same == F.col("_n")).alias("exact_match"), *more)


def scored_steps(steps: DataFrame) -> DataFrame:
    """Counts of matched fields as fidelity and exact match."""
    return steps.withColumn("field_fidelity", F.round(F.col("matched") / F.col("n_active"), 4)).withColumn("exact_match", F.col("matched") == F.col("n_active"))


def carry_hard_collapse(steps: DataFrame) -> DataFrame:
    """After the first step that fails to render, all steps count as failed."""
    first = F.min(F.when(~F.col("render_ok"), F.col("step"))).over(Window.partitionBy("chart_id"))
    dead = F.coalesce(F.col("step") >= F.col("collapse_step"), F.lit(False))
    out = steps.withColumn("collapse_step", first)
    return out.withColumns({"render_ok": F.col("render_ok") & ~dead, "exact_match": F.col("exact_match") & ~dead, "field_fidelity": F.when(dead, 0.0).otherwise(F.col("field_fidelity"))})


def workflow_alive(steps: DataFrame) -> DataFrame:
    """Add `alive`: every step up to this one rendered and matched."""
    w = Window.partitionBy("chart_id").orderBy("step").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return steps.withColumn("alive", F.min(F.col("render_ok") & F.col("exact_match")).over(w))


def step_summary(steps: DataFrame, reported=REPORTED_STEPS) -> DataFrame:
    rate = lambda c: F.round(F.avg(F.col(c).cast("double")), 4)
    alive = workflow_alive(steps).where(F.col("step").isin(*reported))
    return alive.groupBy("step").agg(rate("render_ok").alias("render_survival"), rate("exact_match").alias("exact_match_rate"), F.round(F.avg("field_fidelity"), 4).alias("average_field_fidelity"), rate("alive").alias("workflow_survival"))


def first_bad_step(steps: DataFrame, bad: Column, none: str) -> DataFrame:
    """(step, n): charts by the first step where `bad` holds, `none` for those without one."""
    first = steps.groupBy("chart_id").agg(F.min(F.when(bad, F.col("step"))).alias("_s"))
    return first.groupBy(F.coalesce(F.col("_s").cast("string"), F.lit(none)).alias("step")).agg(F.count(F.lit(1)).alias("n"))


def collapse_distribution(steps: DataFrame) -> DataFrame:
    return first_bad_step(steps, ~F.col("render_ok"), "no_hard_crash")


def drift_distribution(steps: DataFrame) -> DataFrame:
    return first_bad_step(steps, ~(F.col("render_ok") & F.col("exact_match")), "no_drift")


def option_page(options: DataFrame, head: str, tail: str, option: str = "option") -> DataFrame:
    """Add `page`: the option inside a page template."""
    return options.withColumn("page", F.concat(F.lit(head), F.col(option), F.lit(tail)))
