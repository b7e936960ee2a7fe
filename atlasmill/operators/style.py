"""Value frequencies, category order and style settings."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import colors
from ..functions.cells import display_values, extract_categories
from ..functions.scalars import MISSING_KEY, STYLE_MISSING
from .ordering import position_in_group

# Marker vocabulary and the keys a style may set.
SHAPES = ["circle", "diamond", "plus", "square", "triangle-down", "triangle-up"]
SETTING_KEYS = [
    "hiddenValues", "maxVisibleValues", "pinnedValues", "selectedPaletteId", "shapeSize", "sortMode", "zOrderSort",
]
ZORDER_MISSING = ["", "<NA>", "NaN"]
REST = "__REST__"


def unpivot(annotations: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Wide text table -> (annotation, cell)."""
    cols = columns or annotations.columns[1:]
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("annotation"), F.col(c).cast("string").alias("cell")) for c in cols]))
    return annotations.select(pairs.alias("p")).select("p.annotation", "p.cell")


def value_frequencies(annotations: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Count of every display value per annotation: (annotation, value, n)."""
    long = unpivot(annotations, columns).withColumn("value", F.explode(display_values("cell")))
    return long.groupBy("annotation", "value").agg(F.count("*").alias("n"))


def zorder(freq: DataFrame, mode: str = "size-desc", missing: list[str] = ZORDER_MISSING) -> DataFrame:
    """Stack order 0.. per annotation; missing labels always last.

    An annotation may have any number of distinct values, so positions come
    from a range sort.
    """
    keys = {
        "size-desc": [F.desc("n"), F.asc("value")],
        "size-asc": [F.asc("n"), F.asc("value")],
        "alpha-desc": [F.desc("value")],
    }.get(mode, [F.asc("value")])
    is_missing = F.col("value").isin(missing)
    order = [is_missing.asc(), *keys, F.asc("value")]
    return position_in_group(freq, ["annotation"], order, "zorder").withColumn("zorder", F.col("zorder").cast("int"))


def top_categories(cells: DataFrame, cell_col: str = "cell", top: int = 9) -> DataFrame:
    """Most common cleaned categories (ties by value) and the missing slot.

    (value, n, zorder): the missing key is last, present only if some cell has
    no category.
    """
    cats = cells.select(extract_categories(cell_col).alias("cats"))
    counts = cats.select(F.explode("cats").alias("value")).groupBy("value").agg(F.count("*").alias("n"))
    best = counts.orderBy(F.desc("n"), "value").limit(top)
    ranked = best.withColumn(
        "zorder", (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("n"), "value")) - 1).cast("int")
    )
    blank = cats.filter(F.size("cats") == 0).agg(F.count("*").alias("n")).filter("n > 0").select(
        F.lit(MISSING_KEY).alias("value"), "n", F.lit(top).alias("zorder")
    )
    return ranked.select("value", "n", "zorder").unionByName(blank)


def rest_autofill(freq: DataFrame, pinned: list[str], max_visible: int = 10, mode: str = "size-desc") -> DataFrame:
    """Visible categories for a pinned list; ``__REST__`` is filled by rank.

    (annotation, value, zorder), at most ``max_visible`` per annotation when the
    marker is used.
    """
    spark = freq.sparkSession
    slots = spark.createDataFrame([(i, v) for i, v in enumerate(pinned)], "slot int, wanted string")
    canon = lambda c: F.when(F.col(c).isin(STYLE_MISSING), F.lit(MISSING_KEY)).otherwise(F.col(c))
    wanted = slots.filter(F.col("wanted") != REST).withColumn("_c", canon("wanted"))
    exact_first = F.row_number().over(
        Window.partitionBy("annotation", "slot").orderBy(F.desc(F.col("value") == F.col("wanted")), "value")
    )
    explicit = (
        freq.withColumn("_c", canon("value"))
        .join(F.broadcast(wanted), "_c")
        .withColumn("_k", exact_first)
        .filter("_k = 1")
        .select("annotation", "slot", "value", F.lit(0).alias("inner"))
    )
    if REST in pinned:
        used = explicit.groupBy("annotation").agg(F.count("*").alias("used"))
        left = freq.join(explicit.select("annotation", "value"), ["annotation", "value"], "left_anti")
        left = zorder(left.filter(~F.col("value").isin(STYLE_MISSING)), mode)
        left = left.join(used, "annotation", "left").filter(
            F.col("zorder") < F.lit(max_visible) - F.coalesce("used", F.lit(0))
        )
        fill = left.select("annotation", F.lit(pinned.index(REST)).alias("slot"), "value", F.col("zorder").alias("inner"))
        explicit = explicit.unionByName(fill)
    rank = F.row_number().over(Window.partitionBy("annotation").orderBy("slot", "inner"))
    return explicit.select("annotation", "value", (rank - 1).cast("int").alias("zorder"))


def check_style_values(styles: dict, freq: DataFrame) -> None:
    """Refuse styles for annotations or values that do not exist."""
    spark = freq.sparkSession
    wanted = [
        (a, str(v)) for a, s in styles.items() for part in ("colors", "shapes") for v in s.get(part, {})
    ]
    known = {r["annotation"] for r in freq.select("annotation").distinct().collect()}
    for annotation in styles:
        if annotation not in known:
            raise ValueError(f"Annotation '{annotation}' does not exist. Available: {sorted(known)}")
    if not wanted:
        return
    table = spark.createDataFrame(wanted, "annotation string, value string")
    canon = lambda c: F.when(c.isin(STYLE_MISSING), F.lit(MISSING_KEY)).otherwise(c)
    have = freq.select("annotation", canon(F.col("value")).alias("value")).distinct()
    absent = table.withColumn("value", canon(F.col("value"))).join(have, ["annotation", "value"], "left_anti").take(1)
    if absent:
        raise ValueError(f"Value '{absent[0]['value']}' does not exist for annotation '{absent[0]['annotation']}'")


def style_template(freq: DataFrame) -> DataFrame:
    """Pre-filled style rows, values by descending frequency: (annotation, value, color, position)."""
    color = F.when(F.col("value").isin(ZORDER_MISSING), F.lit(colors.MISSING_COLOR)).otherwise(F.lit(""))
    ranked = position_in_group(freq, ["annotation"], [F.desc("n"), "value"], "position")
    return ranked.select("annotation", "value", color.alias("color"), F.col("position").cast("int").alias("position"))


def template_dict(freq: DataFrame) -> dict:
    out = {}
    for r in sorted(style_template(freq).collect(), key=lambda r: (r["annotation"], r["position"])):
        entry = out.setdefault(r["annotation"], {
            "sortMode": "size-desc", "maxVisibleValues": 10, "shapeSize": 30, "selectedPaletteId": "kellys",
            "hiddenValues": [], "colors": {}, "shapes": {},
        })
        entry["colors"][r["value"]] = r["color"]
    return out


def settings_rows(settings: dict, spark) -> DataFrame:
    """Settings document -> (annotation, value, zorder, color, shape)."""
    text = spark.createDataFrame([(json.dumps(settings),)], "j string")
    schema = "map<string,struct<categories:map<string,struct<zOrder:int,color:string,shape:string>>>>"
    return text.select(F.explode(F.from_json("j", schema)).alias("annotation", "s")).select(
        "annotation", F.explode("s.categories").alias("value", "c")
    ).select("annotation", "value", F.col("c.zOrder").alias("zorder"), "c.color", "c.shape")


def settings_to_state(settings: dict, spark) -> dict:
    """Settings -> {annotation_colors, marker_shapes} with rgba colours."""
    rows = settings_rows(settings, spark).withColumn("color", colors.hex_to_rgba("color")).collect()
    state: dict = {"annotation_colors": {}, "marker_shapes": {}}
    for r in rows:
        if r["color"]:
            state["annotation_colors"].setdefault(r["annotation"], {})[r["value"]] = r["color"]
        if r["shape"]:
            state["marker_shapes"].setdefault(r["annotation"], {})[r["value"]] = r["shape"]
    return state


def state_rows(state: dict, spark) -> DataFrame:
    """State -> (annotation, value, color, shape), colours as hex."""
    pairs = {}
    for part, slot in (("annotation_colors", 0), ("marker_shapes", 1)):
        for annotation, values in state.get(part, {}).items():
            for value, what in values.items():
                pairs.setdefault((annotation, value), [None, None])[slot] = what
    rows = [(a, v, c, s) for (a, v), (c, s) in pairs.items()]
    df = spark.createDataFrame(rows, "annotation string, value string, color string, shape string")
    return df.withColumn("color", colors.rgba_to_hex("color"))


# What a settings document says where nothing else does.
DEFAULT_SWITCHES = {
    "enableDuplicateStackUI": False, "hiddenValues": [], "includeShapes": False, "maxVisibleValues": 10, "selectedPaletteId": "kellys",
    "shapeSize": 30, "sortMode": "size-desc",
}


def _ordered(freq: DataFrame, styled: DataFrame, annotation: str, switches: dict) -> DataFrame:
    """(annotation, value, zorder, pinned) of one annotation's visible categories.

    A style names the values it wants; without one all values of the data are there.
    """
    mine = freq.filter(F.col("annotation") == annotation)
    named = styled.filter(F.col("annotation") == annotation).select("annotation", "value")
    missing = named.join(mine, ["annotation", "value"], "left_anti").withColumn("n", F.lit(0).cast("bigint"))
    some = named.limit(1).agg(F.count("*") > 0).scalar()
    chosen = mine.join(named.withColumn("_named", F.lit(True)), ["annotation", "value"], "left").filter(F.col("_named") | ~some)
    table = chosen.select("annotation", "value", "n").unionByName(missing)
    mode, pinned = switches.get("zOrderSort") or switches["sortMode"], switches.get("pinnedValues")
    visible = rest_autofill(table, pinned, switches["maxVisibleValues"], mode) if pinned else zorder(table, mode)
    return visible.select("annotation", "value", "zorder", F.lit(bool(pinned)).alias("pinned"))


def category_rows(freq: DataFrame, switches: dict[str, dict], state: dict | None = None, existing: dict | None = None) -> DataFrame:
    """Settings as rows: (annotation, value, key, zorder, color, shape), one per visible category.

    A colour is the style's, else the stored one, else (pinned lists only) the next of the palette among the
    categories still without one; a shape is the style's, else the stored one, else a circle. ``key`` is the name of the
    category in a document. Any number of categories stays in Spark.
    """
    spark = freq.sparkSession
    styled = state_rows(state or {}, spark)
    stored = settings_rows(existing or {}, spark).withColumnsRenamed({"color": "old_color", "shape": "old_shape"}).drop("zorder")
    parts = [_ordered(freq, styled, a, s) for a, s in sorted(switches.items())]
    if not parts:
        return spark.createDataFrame([], "annotation string, value string, key string, zorder int, color string, shape string")
    placed = parts[0]
    for more in parts[1:]:
        placed = placed.unionByName(more)
    joined = placed.join(styled, ["annotation", "value"], "left").join(stored, ["annotation", "value"], "left")
    blank = lambda c: F.nullif(F.col(c), F.lit(""))
    is_missing = F.col("value").isin(STYLE_MISSING)
    given = F.coalesce(blank("color"), blank("old_color"))
    needs = F.col("pinned") & given.isNull() & ~is_missing
    # only pinned lists draw from the palette, and those are as short as what is shown
    turn = F.sum(F.when(needs, 1).otherwise(0)).over(Window.partitionBy("annotation", "pinned", F.when(~F.col("pinned"), F.col("value"))).orderBy("zorder"))
    palette = F.element_at(F.array(*[F.lit(c) for c in colors.KELLY_PALETTE]), ((turn - 1) % len(colors.KELLY_PALETTE) + 1).cast("int"))
    filled = F.when(F.col("pinned") & is_missing, F.lit(colors.PINNED_MISSING_COLOR)).when(needs, palette)
    return joined.select(
        "annotation", "value", F.when(is_missing, F.lit(MISSING_KEY)).otherwise(F.col("value")).alias("key"), "zorder",
        F.coalesce(given, filled).alias("color"), F.coalesce("shape", "old_shape", F.lit("circle")).alias("shape"))


def build_settings(
    freq: DataFrame, state: dict | None = None, existing: dict | None = None, overrides: dict | None = None
) -> dict:
    """Settings document of :func:`category_rows`, with the switches of each annotation beside its categories."""
    state, existing, overrides = state or {}, existing or {}, overrides or {}
    shaped = {a for a, values in state.get("marker_shapes", {}).items() if any(values.values())}
    switches = {}
    for annotation in {*state.get("annotation_colors", {}), *shaped, *overrides}:
        kept = {k: v for k, v in existing.get(annotation, {}).items() if k != "categories"}
        set_now = {k: v for k, v in overrides.get(annotation, {}).items() if k in SETTING_KEYS}
        switches[annotation] = DEFAULT_SWITCHES | kept | set_now | ({"includeShapes": True} if annotation in shaped else {})
    document = {a: {k: v for k, v in s.items() if k not in ("pinnedValues", "zOrderSort")} | {"categories": {}} for a, s in sorted(switches.items())}
    for r in sorted(category_rows(freq, switches, state, existing).collect(), key=lambda r: (r["annotation"], r["zorder"])):
        old = existing.get(r["annotation"], {}).get("categories", {}).get(r["value"], {})
        new = {"zOrder": r["zorder"], "shape": r["shape"]} | ({"color": r["color"]} if r["color"] else {})
        document[r["annotation"]]["categories"][r["key"]] = old | new
    return document


def apply_styles(annotations: DataFrame, styles: dict, existing: dict | None = None) -> dict:
    """Check a styles document against the data and turn it into settings."""
    freq = value_frequencies(annotations)
    check_style_values(styles, freq)
    state = {
        "annotation_colors": {a: s["colors"] for a, s in styles.items() if s.get("colors")},
        "marker_shapes": {a: s["shapes"] for a, s in styles.items() if s.get("shapes")},
    }
    overrides = {a: {k: v for k, v in s.items() if k in SETTING_KEYS} for a, s in styles.items()}
    return build_settings(freq, state, existing, {a: o for a, o in overrides.items() if o})


def restyle_top(annotations: DataFrame, settings: dict, columns: list[str], top: int = 9) -> dict:
    """Settings with the categories of some annotations recomputed from the data."""
    out = dict(settings)
    for c in columns:
        if c not in annotations.columns or c not in settings:
            continue
        rows = sorted(top_categories(annotations.select(F.col(c).alias("cell")), "cell", top).collect(), key=lambda r: r["zorder"])
        out[c] = {**settings[c], "categories": {
            r["value"]: {
                "zOrder": r["zorder"],
                "color": colors.MISSING_COLOR if r["value"] == MISSING_KEY else colors.KELLY_PALETTE[r["zorder"] % len(colors.KELLY_PALETTE)],
                "shape": "circle",
            } for r in rows
        }}
    return out
