"""Named colours of images: naming, profiles, merging, clusters."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..sources.writers import settle

ACHROMATIC = 14
MERGE_DISTANCE = 14


def nearest_color(colors: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Add `name` and the dictionary's l0, l1, l2 to rows (c0, c1, c2): the nearest entry, the first of equals.

    The dictionary stands as one array beside each row, so nothing is joined on a colour, of which one may fill most of all images, and
    no rows multiply. Count colours by image first where pixels aren't wanted one by one.
    """
    entries = dictionary.agg(F.array_sort(F.collect_list(F.struct("idx", "name", "l0", "l1", "l2"))).alias("_d"))
    square = lambda a, b: (a - b) * (a - b)
    ranked = F.transform("_d", lambda e: F.struct((square(F.col("c0"), e["l0"]) + square(F.col("c1"), e["l1"]) + square(F.col("c2"), e["l2"])).alias("dist"), e["idx"].alias("idx"), e["name"].alias("name"), e["l0"].alias("l0"), e["l1"].alias("l1"), e["l2"].alias("l2")))
    named = colors.crossJoin(F.broadcast(entries)).withColumn("_nearest", F.array_min(ranked))  # one row
    return named.select(*[F.col(f"`{c}`") for c in colors.columns], "_nearest.name", "_nearest.l0", "_nearest.l1", "_nearest.l2")


def color_profile(pixels: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(image, name, n, share, l0, l1, l2): pixels of each named colour, their percentage, and the mean of its dictionary colours, cut to whole numbers."""
    return profile_of_counts(pixels.groupBy("image", "c0", "c1", "c2").agg(F.count(F.lit(1)).alias("n")), dictionary)


def profile_of_counts(counts: DataFrame, dictionary: DataFrame) -> DataFrame:
    """``color_profile`` of rows (image, c0, c1, c2, n): how many pixels of an image have a colour."""
    named = nearest_color(counts.withColumnRenamed("n", "_n"), dictionary)
    profile = named.groupBy("image", "name").agg(F.sum("_n").alias("n"), *[F.floor(F.avg(c)).cast("long").alias(c) for c in ("l0", "l1", "l2")])
    return with_shares(profile)


def with_shares(profile: DataFrame) -> DataFrame:
    return profile.withColumn("share", F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy("image")))


def sorted_profile(profile: DataFrame) -> DataFrame:
    """Add `place`: colours by share, ties by name."""
    order = Window.partitionBy("image").orderBy(F.desc("n"), "name")
    return profile.withColumn("place", F.row_number().over(order).cast("long"))


def achromatic(a: Column, b: Column, t: int = ACHROMATIC) -> Column:
    return a.between(128 - t, 128 + t) & b.between(128 - t, 128 + t)


def achromatic_split(df: DataFrame, t: int = ACHROMATIC, a: str = "l1", b: str = "l2") -> DataFrame:
    """Add `achromatic`, and `all_achromatic` for images without any other colour."""
    out = df.withColumn("achromatic", achromatic(F.col(a), F.col(b), t))
    return out.withColumn("all_achromatic", F.bool_and("achromatic").over(Window.partitionBy("image")))


def foreground(named: DataFrame, background: list[str]) -> DataFrame:
    """Rows whose name is no background colour."""
    return named.where(~F.col("name").isin(*background))


def apply_lookup(profile: DataFrame, lookup: DataFrame, background: list[str] | None = None) -> DataFrame:
    """Colours under the names they were merged into, shares taken anew, over the foreground if a background is given."""
    rows = foreground(profile, background) if background else profile
    merged = rows.join(lookup, "name", "left").withColumn("name", F.coalesce("merged", "name"))
    return with_shares(merged.groupBy("image", "name").agg(F.sum("n").alias("n")))


def similar_pairs(profile: DataFrame, similarity: DataFrame) -> DataFrame:
    """(image, name, absorbs): colours of one image of which the first may take in the second; similarity: (name, similar_name)."""
    here = profile.select("image", "name")
    return here.join(similarity, "name").join(here.withColumnsRenamed({"name": "similar_name"}), ["image", "similar_name"]).select("image", "name", F.col("similar_name").alias("absorbs"))


def _distances(profile: DataFrame) -> DataFrame:
    side = lambda s: profile.select("image", *[F.col(c).alias(c + s) for c in ("name", "l0", "l1", "l2")])
    square = lambda c: (F.col(c + "_a") - F.col(c + "_b")) * (F.col(c + "_a") - F.col(c + "_b"))
    pairs = side("_a").join(side("_b"), "image").where("name_a <> name_b")
    return pairs.select("image", "name_a", "name_b", F.round(F.sqrt((square("l0") + square("l1") + square("l2")).cast("double")), 2).alias("distance"))


def nearest_color_pairs(profile: DataFrame) -> DataFrame:
    """(image, name, nearest, distance): each colour's nearest other one in its image, ties by name. An image has few named colours."""
    return _distances(profile).groupBy("image", F.col("name_a").alias("name")).agg(F.min(F.struct("distance", "name_b")).alias("_m")).select("image", "name", F.col("_m.name_b").alias("nearest"), F.col("_m.distance").alias("distance"))


def closest_pairs_sorted(profile: DataFrame) -> DataFrame:
    """(image, name_a, name_b, distance, place): every pair of an image's colours once, by distance."""
    order = Window.partitionBy("image").orderBy("distance", "name_a", "name_b")
    return _distances(profile).where("name_a < name_b").withColumn("place", F.row_number().over(order).cast("long"))


def light_adjacent_distance(profile: DataFrame) -> DataFrame:
    """Add `next_distance`: from each colour to the next darker one of its image."""
    order = Window.partitionBy("image").orderBy(F.desc("l0"), "name")
    gap = lambda c: F.col(c) - F.lead(c).over(order)
    square = gap("l0") * gap("l0") + gap("l1") * gap("l1") + gap("l2") * gap("l2")
    return profile.withColumn("next_distance", F.sqrt(square.cast("double")))


def cluster_mode_color(members: DataFrame, clusters: DataFrame) -> DataFrame:
    """(image, cluster, c0, c1, c2): each cluster's most frequent colour, the first of equals; its centre where it has no member."""
    mode = members.groupBy("image", "cluster").agg(F.max_by(F.struct("c0", "c1", "c2"), F.struct("n", (-F.col("c0")).alias("a"), (-F.col("c1")).alias("b"), (-F.col("c2")).alias("c"))).alias("_m"))
    both = clusters.join(mode, ["image", "cluster"], "left")
    return both.select("image", "cluster", *[F.coalesce(F.col(f"_m.{c}"), F.col(f"centre_{c}")).alias(c) for c in ("c0", "c1", "c2")])


def cluster_membership(members: DataFrame) -> DataFrame:
    return members.groupBy("image", "cluster").agg(F.sort_array(F.collect_list("name")).alias("names"))


def representative_lab(named_pixels: DataFrame) -> DataFrame:
    """(image, name, c0, c1, c2): the colour of each name's first pixel by row."""
    return named_pixels.groupBy("image", "name").agg(F.min_by(F.struct("c0", "c1", "c2"), F.struct("y", "x")).alias("_p")).select("image", "name", "_p.*")


# --- order-dependent merges: one image's named colours at a time, a few dozen rows


def _merge_similar(names: list[str], shares: list[float], may: dict[str, set[str]]) -> dict[str, str]:
    """Who ends up under which name: from the smallest share up, a colour joins the next larger one that lists it, and the search starts anew."""
    groups = {n: [n] for n in names}
    rows = sorted(zip(names, shares), key=lambda r: -r[1])
    i = len(rows) - 1
    while i > 0:
        taker = next((j for j in range(i - 1, -1, -1) if rows[i][0] in may.get(rows[j][0], ())), None)
        if taker is None:
            i -= 1
            continue
        name, share = rows.pop(i)
        rows[taker] = (rows[taker][0], rows[taker][1] + share)
        groups[rows[taker][0]] += groups.pop(name)
        rows.sort(key=lambda r: -r[1])
        i = len(rows) - 1
    return {member: root for root, members in groups.items() for member in members}


def _merge_lightness(names: list[str], labs: np.ndarray, t: float) -> dict[str, str]:
    """Who ends up under which name: the closest neighbours by lightness merge into the lighter one while they are close enough."""
    order = np.argsort(-labs[:, 0], kind="stable").tolist()
    root = {n: n for n in names}
    while len(order) > 1:
        gaps = [float(np.linalg.norm(labs[a] - labs[b])) for a, b in zip(order, order[1:])]
        at = int(np.argmin(gaps))
        if gaps[at] > t:
            break
        keep, gone = names[order[at]], names[order[at + 1]]
        root = {n: keep if r == gone else r for n, r in root.items()}
        del order[at + 1]
    return root


def _one_by_one(images: pa.Array, work, kind: pa.DataType) -> pa.Array:
    """`work` on each value of a batch; only a few images' colours are Python objects at a time, and few results."""
    parts = [pa.array([work(x) for x in images.slice(k, 100).to_pylist()], kind) for k in range(0, len(images), 100)]
    return pa.concat_arrays(parts) if parts else pa.array([], kind)


def _by_image(profile: DataFrame, columns: list[str], work, kind: str) -> DataFrame:
    """(image, ...): `work` on each image's named colours, a list of dicts that gives a list of dicts of the fields of `kind`. An image's
    colours are one value, a dictionary's entries at most, and a batch of images goes through one Arrow UDF."""
    fields = T.ArrayType(T.StructType.fromDDL(kind))

    @F.arrow_udf(fields)
    def run(images: pa.Array) -> pa.Array:
        return _one_by_one(images, work, to_arrow_type(fields))

    lists = profile.groupBy("image").agg(F.collect_list(F.struct(*columns)).alias("_c"))
    return lists.select("image", F.explode(run("_c")).alias("_r")).select("image", "_r.*")


def _absorbing(profile: DataFrame, similarity: DataFrame) -> DataFrame:
    """(image, name, may): the names that a colour may take in. Similar names are one list for each dictionary entry, a table as small as the dictionary."""
    lists = similarity.groupBy("name").agg(F.collect_set("similar_name").alias("may"))
    return profile.join(lists, "name", "left")


def _merged_similar(colors: list[dict]) -> dict[str, str]:
    colors = sorted(colors, key=lambda c: (-c["n"], c["name"]))
    return _merge_similar([c["name"] for c in colors], [c["n"] for c in colors], {c["name"]: set(c["may"] or ()) for c in colors})


def _merged_lightness(colors: list[dict], t: float) -> dict[str, str]:
    colors = sorted(colors, key=lambda c: (-c["l0"], c["name"]))
    return _merge_lightness([c["name"] for c in colors], np.array([[c["l0"], c["l1"], c["l2"]] for c in colors], float), t)


def semantic_merge(profile: DataFrame, similarity: DataFrame) -> DataFrame:
    """(image, name, merged) for the chromatic colours of each image."""
    work = lambda colors: [{"name": n, "merged": m} for n, m in _merged_similar(colors).items()]
    return _by_image(_absorbing(profile, similarity), ["name", "n", "may"], work, "name string, merged string")


def lightness_merge(profile: DataFrame, t: float = MERGE_DISTANCE) -> DataFrame:
    """(image, name, merged) by closeness of neighbours in lightness."""
    work = lambda colors: [{"name": n, "merged": m} for n, m in _merged_lightness(colors, t).items()]
    return _by_image(profile, ["name", "l0", "l1", "l2"], work, "name string, merged string")


def count_named_colors(profile: DataFrame, similarity: DataFrame, t: float = MERGE_DISTANCE, background: list[str] | None = None, bw: bool = False) -> DataFrame:
    """(image, n_colors, names): distinct names after merging similar chromatic colours and colours close in lightness.

    The second merge takes the achromatic colours if there are any, else all. `bw` skips the first merge and takes all
    colours into the second. Background colours, if given, are left out before and added to the names at the end.
    """
    rows = foreground(profile, background) if background else profile
    rows = rows.withColumn("achromatic", achromatic(F.col("l1"), F.col("l2")))

    def work(colors: list[dict]) -> list[dict]:
        chromatic = [] if bw else [c for c in colors if not c["achromatic"]]
        merged = {c["name"]: c["name"] for c in colors} | (_merged_similar(chromatic) if chromatic else {})
        roots = [c for c in colors if merged[c["name"]] == c["name"]]
        close = colors if bw else [c for c in roots if c["achromatic"]] or roots
        last = _merged_lightness(close, t)
        return [{"names": sorted({last.get(m, m) for m in merged.values()})}]

    found = _by_image(_absorbing(rows, similarity), ["name", "n", "l0", "l1", "l2", "achromatic", "may"], work, "names array<string>")
    names = F.array_sort(F.array_union("names", F.array(*map(F.lit, background)))) if background else F.col("names")
    return found.select("image", names.alias("names")).withColumn("n_colors", F.size("names").cast("long"))


def _image_colors(profile: DataFrame, *parts: Column) -> DataFrame:
    """(image, colors): the named colours of each image as an array of structs, sorted by its parts; an image has no more of them than the dictionary."""
    return profile.groupBy("image").agg(F.array_sort(F.collect_list(F.struct(*parts))).alias("colors"))


def leader_groups(profile: DataFrame, t: float = 25) -> DataFrame:
    """(image, name, leader): from dark to light, each unclaimed colour leads the later unclaimed ones less than t lighter."""
    rows = _image_colors(profile, F.col("l0").cast("double").alias("l0"), F.col("name"))
    start = F.struct(F.lit(None).cast("double").alias("l0"), F.lit(None).cast("string").alias("name"), F.array().cast("array<struct<name:string,leader:string>>").alias("out"))

    def step(s, c):  # sorted, so those that a leader claims follow it without a gap
        new = s["l0"].isNull() | (c["l0"] - s["l0"] >= t)
        leader = F.when(new, c["name"]).otherwise(s["name"])
        return F.struct(F.when(new, c["l0"]).otherwise(s["l0"]).alias("l0"), leader.alias("name"), F.concat(s["out"], F.array(F.struct(c["name"].alias("name"), leader.alias("leader")))).alias("out"))

    return rows.select("image", F.inline(F.aggregate("colors", start, step, lambda s: s["out"])))


#: The cells that a point of a three-dimensional grid has to meet: its own and one of each pair of opposite neighbours.
_HALF = [(x, y, z) for x in (-1, 0, 1) for y in (-1, 0, 1) for z in (-1, 0, 1) if (x, y, z) >= (0, 0, 0)]


def radius_edges(points: DataFrame, eps: float) -> DataFrame:
    """(image, a, b): pairs of names of an image that are at most `eps` apart, each once. Points meet those of their own cell of a grid of side eps and of half of its neighbours."""
    axes = ("l0", "l1", "l2")
    cell = lambda c: F.floor(F.col(c) / eps)
    left = points.select("image", F.col("name").alias("a"), *[F.col(c).alias(f"a{c}") for c in axes], *[cell(c).alias(f"x{c}") for c in axes])
    steps = F.explode(F.array(*[F.struct(*[F.lit(v).cast("long").alias(c) for v, c in zip(step, axes)]) for step in _HALF]))
    right = points.select("image", F.col("name").alias("b"), *axes, steps.alias("_s")).select("image", "b", *axes, *[(cell(c) - F.col(f"_s.{c}")).alias(f"x{c}") for c in axes], F.expr("_s.l0 = 0 AND _s.l1 = 0 AND _s.l2 = 0").alias("_own"))
    square = sum((F.col(f"a{c}") - F.col(c)) * (F.col(f"a{c}") - F.col(c)) for c in axes)
    met = left.join(right, ["image", *[f"x{c}" for c in axes]])
    return met.where((square <= eps * eps) & (~F.col("_own") | (F.col("a") < F.col("b")))).select("image", "a", "b")


def radius_components(profile: DataFrame, eps: float = 14, most_rounds: int = 100) -> DataFrame:
    """(image, name, component): colours joined by steps of at most eps; a component bears its first name.

    Every round takes the smallest label among neighbours, then that label's own label, so labels travel twice as far each
    time; rounds are written, and end when no label has changed.
    """
    points = settle(profile.select("image", "name", *[F.col(c).cast("double").alias(c) for c in ("l0", "l1", "l2")]), "points")
    edges = radius_edges(points, eps)
    both = settle(edges.unionByName(edges.select("image", F.col("b").alias("a"), F.col("a").alias("b"))), "near-points")
    labels = points.select("image", "name", F.col("name").alias("component"))
    for _ in range(most_rounds):
        seen = both.join(labels.select("image", F.col("name").alias("b"), F.col("component").alias("c")), ["image", "b"]).groupBy("image", F.col("a").alias("name")).agg(F.min("c").alias("c"))
        near = labels.join(seen, ["image", "name"], "left").select("image", "name", F.least("component", "c").alias("component"), F.col("component").alias("was"))
        far = near.select("image", F.col("name").alias("component"), F.col("component").alias("further"))
        labels = settle(near.join(far, ["image", "component"]).select("image", "name", F.least("component", "further").alias("component"), "was"), "labels")
        if labels.where("component <> was").limit(1).count() == 0:
            return labels.drop("was")
        labels = labels.drop("was")
    raise RuntimeError("components did not settle")


def weighted_kmeans(profile: DataFrame, k: int = 5, rounds: int = 50) -> DataFrame:
    """(image, cluster, name, share): colours clustered by LAB, weighted by log(1 + pixels); `share` is the cluster's percentage of weight, two decimals.

    Centres start at the heaviest colour and then the farthest ones, so runs agree; of equally far colours the heavier, then the
    first by name. The centres of an image are an array beside its colours, and rounds are folds over both.
    """
    axes = ("l0", "l1", "l2")
    rows = _image_colors(profile, (-F.col("n")).alias("less"), F.col("name"), F.log1p(F.col("n").cast("double")).alias("w"), *[F.col(c).cast("double").alias(c) for c in axes])
    point = lambda c: F.struct(*[c[x].alias(x) for x in axes])
    away = lambda a, b: sum((a[x] - b[x]) * (a[x] - b[x]) for x in axes)
    nearest = lambda c, centres: F.array_min(F.transform(centres, lambda z, i: F.struct(away(c, z).alias("d"), i.alias("i"))))

    def add_farthest(centres, _):
        far = F.array_min(F.transform("colors", lambda c, i: F.struct((-nearest(c, centres)["d"]).alias("d"), i.alias("i"))))
        return F.concat(centres, F.array(point(F.get("colors", far["i"]))))

    first = F.transform(F.slice("colors", 1, 1), point)
    more = F.slice(F.sequence(F.lit(1), F.lit(k)), 1, F.least(F.lit(k), F.size("colors")) - 1)
    rows = rows.select("image", "colors", F.aggregate(more, first, add_farthest).alias("centres"))

    def round_(state, _):
        centres = state["centres"]

        def moved(own):
            def centre(z, i):
                total = F.aggregate(own, F.array(*[F.lit(0.0)] * 4), lambda s, c: F.when(c["i"] == i, F.zip_with(s, F.array(c["w"], *[c["w"] * c[x] for x in axes]), lambda a, b: a + b)).otherwise(s))
                return F.when(total[0] > 0, F.struct(*[(total[j + 1] / total[0]).alias(x) for j, x in enumerate(axes)])).otherwise(z)

            return F.transform(centres, centre)

        own = F.transform("colors", lambda c: F.struct(nearest(c, centres)["i"].alias("i"), c["w"].alias("w"), *[c[x].alias(x) for x in axes]))
        once = F.transform(F.array(own), moved)  # bound once, not for every centre
        after = F.get(F.transform(once, lambda m: F.struct(m.alias("centres"), (m == centres).alias("settled"))), 0)
        return F.when(state["settled"], state).otherwise(after)

    begin = F.struct("centres", F.lit(False).alias("settled"))
    rows = rows.select("image", "colors", F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), begin, round_, lambda s: s["centres"]).alias("centres"))
    each = rows.select("image", F.explode(F.transform("colors", lambda c: F.struct(nearest(c, F.col("centres"))["i"].cast("long").alias("cluster"), c["name"].alias("name"), c["w"].alias("w")))).alias("c")).select("image", "c.*")
    weight = F.sum("w").over(Window.partitionBy("image", "cluster")) / F.sum("w").over(Window.partitionBy("image"))
    return each.select("image", "cluster", "name", F.round(weight * 100, 2).alias("share"))
