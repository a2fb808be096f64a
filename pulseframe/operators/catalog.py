"""The catalog of derived features, and the long feature table that it defines."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulseframe.operators import features as X

# Names of the raw features and of the functions taken of them.
GROUPS = ("facial", "acoustic", "movement", "acoustic_seg", "audio_seg", "eyeblink_ear", "facial_tremor")
EMOTIONS = ("hap", "sad", "sur", "fea", "ang", "dis", "con")
LEVELS = ("soft", "hard")
UNITS = (1, 2, 4, 5, 6, 7, 9, 10, 12, 14, 15, 17, 20, 23, 25, 26, 45)
UNITS_SHOWN = (1, 2, 4, 5, 6, 7, 9, 10, 12, 14, 15, 17, 20, 23, 25, 26, 28, 45)
MASKS = ("mouth", "eyebrow", "eye", "com")
TREMOR_MARKS = (5, 12, 8, 48, 54, 28, 51, 66, 57)
HEAD = ("headvel", "hposedist", "hposepitch", "hposeyaw", "hposeroll")
GAZE = ("lefteyex", "lefteyey", "lefteyez", "righteyex", "righteyey", "righteyez", "leyedisp", "reyedisp")
VOCAL_TREMOR = ("freqtremfreq", "freqtremindex", "freqtrempindex", "amptremfreq", "amptremindex", "amptrempindex")
PAUSE = ("pausetime", "totaltime", "numpauses", "pausefrac")


def _levels(*parts: str) -> list[str]:
    return [f"{part}int{level}" for part in parts for level in LEVELS]


def _subgroups() -> dict[tuple[str, str], list[str]]:
    """(group label, subgroup) -> names without the label, in the order in which a name is looked up."""
    return {
        ("fac", "facial_landmarks"): [f"LMK{i:02}disp" for i in range(68)],
        ("fac", "action_units"): [f"AU{i:02}int" for i in UNITS] + [f"AU{i:02}pres" for i in UNITS_SHOWN],
        ("fac", "emotional_expressivity"): _levels(*EMOTIONS) + [f"{e}pres" for e in EMOTIONS],
        ("fac", "overall_expressivity"): _levels("com", "comlow", "comupp", "pos", "neg"),
        ("fac", "facial_asymmetry"): [f"asymmask{m}" for m in MASKS],
        ("fac", "pain_expressivity"): _levels("pai"),
        ("fac", "facial_tremor"): [f"tremormedian{i}" for i in TREMOR_MARKS],
        ("aco", "fundamental_frequency"): ["ff"],
        ("aco", "formant_frequencies"): [f"fm{i}" for i in range(1, 5)],
        ("aco", "audio_intensity"): ["int"],
        **{("aco", one): [one] for one in ("hnr", "gne", "jitter", "shimmer")},
        ("aco", "pause"): list(PAUSE),
        ("aco", "mfcc"): [f"mfcc{i}" for i in range(1, 13)],
        ("aco", "voice_prevalence"): ["voicepct"],
        ("mov", "vocal_tremor"): list(VOCAL_TREMOR),
        ("mov", "head_movement"): list(HEAD),
        ("mov", "eye_blink"): ["eyeblink", "eyeblinkdur", "blinkear"],
        ("mov", "eye_gaze"): list(GAZE),
    }


SUBGROUPS = {(label, name): subgroup for (label, subgroup), names in reversed(_subgroups().items()) for name in names}


def blocks() -> list[tuple[str, int, list[str], tuple[str, ...]]]:
    """(group, number of the block in it, raw features, functions): the whole catalog."""
    of = lambda label, names: [f"{label}_{n}" for n in names]
    lmk, au = [f"LMK{i:02}disp" for i in range(68)], [f"AU{i:02}int" for i in UNITS]
    return [
        ("facial", 1, of("fac", [*lmk, *au, *_levels(*EMOTIONS), *(f"asymmask{m}" for m in MASKS)]), ("mean", "std")),
        ("facial", 2, of("fac", [f"AU{i:02}pres" for i in UNITS_SHOWN] + [f"{e}pres" for e in EMOTIONS]), ("pct",)),
        ("facial", 3, of("fac", _levels("com", "comlow", "comupp", "pai", "pos", "neg")), ("mean", "std", "pct")),
        ("acoustic", 1, of("aco", ["ff", "fm1", "fm2", "fm3", "fm4", "int", "hnr"]), ("mean", "std", "range")),
        ("acoustic", 2, of("aco", [f"mfcc{i}" for i in range(1, 13)]), ("mean",)),
        ("movement", 1, of("mov", [*HEAD, *GAZE]), ("mean", "std")),
        ("movement", 2, ["mov_eyeblink"], ("count", "dur_mean", "dur_std")),
        ("acoustic_seg", 1, of("aco", ["jitter", "shimmer", "gne"]), ("mean", "wmean", "std", "wstd")),
        ("audio_seg", 1, of("mov", VOCAL_TREMOR) + ["aco_voicepct"], ("mean", "wmean")),
        ("pause", 1, of("aco", PAUSE), ("mean",)),
        ("eyeblink_ear", 1, ["mov_blink_ear"], ("mean", "std")),
        ("facial_tremor", 1, [f"fac_tremor_median_{i}" for i in TREMOR_MARKS], ("mean",)),
    ]


def structure() -> dict[str, int]:
    """The number of blocks of each group."""
    out: dict[str, int] = {}
    for group, *_ in blocks():
        out[group] = out.get(group, 0) + 1
    return out


def parts(raw: str, function: str) -> tuple[str, str | None, str, str]:
    """(group label, subgroup, feature, metric) of a derived column: a first part, a last part, and what lies between as one. Tremor of the face counts as movement."""
    first, *middle, last = f"{raw}_{function}".split("_")
    feature = "".join(middle)
    subgroup = SUBGROUPS.get((first, feature))
    return "mov" if subgroup == "facial_tremor" else first, subgroup, feature, last


def entries() -> list[tuple[str, int, str, str, str, str | None, str, str]]:
    """(group, block, raw, function, label, subgroup, feature, metric), one for each derived column."""
    return [(group, k, raw, f, *parts(raw, f)) for group, k, raws, functions in blocks() for raw in raws for f in functions]


def subgroup_of(rows: DataFrame, label: str, feature: str, name: str = "subgroup") -> DataFrame:
    """rows with the subgroup of the feature in the column `feature` of the group label in the column `label`; null where it is unknown."""
    known = rows.sparkSession.createDataFrame([(a, b, s) for (a, b), s in SUBGROUPS.items()], "_label string, _feature string, _subgroup string")
    joined = rows.join(F.broadcast(known), (F.col(label) == F.col("_label")) & (F.col(feature) == F.col("_feature")), "left")  # a fixed table
    return joined.select(*rows.columns, F.col("_subgroup").alias(name))


def _weighted(x: Column, w: Column, centre: Column) -> tuple[Column, Column]:
    """Weighted mean, and standard deviation with reliability weights, of moments about a centre near the mean, so that nothing cancels."""
    own, off = F.when(x.isNotNull(), w), x - centre
    total, shift = F.sum(own), F.try_divide(F.sum(off * own), F.sum(own))
    square = F.sum(off * off * own) - F.sum(off * own) * shift
    return F.first(centre) + shift, F.sqrt(F.try_divide(F.greatest(F.lit(0.0), square), total - F.try_divide(F.sum(own * own), total)))


def _number(raw: str) -> Column:
    return F.when(~F.isnan(F.col(raw).cast("double")), F.col(raw).cast("double"))


def _centred(df: DataFrame, keys: Sequence[str], raws: Sequence[str]) -> DataFrame:
    """df with _c_<raw>, the mean of each raw column over the key, which weighted moments are taken about."""
    means = df.groupBy(*keys).agg(*(F.avg(_number(raw)).alias(f"_c_{raw}") for raw in raws))
    names = means.select(*(F.col(k).alias(f"_k_{k}") for k in keys), *(f"_c_{raw}" for raw in raws))
    return df.join(names, reduce(lambda x, y: x & y, (df[k].eqNullSafe(names[f"_k_{k}"]) for k in keys)), "left").drop(*(f"_k_{k}" for k in keys))


def _summed(df: DataFrame, keys: Sequence[str], sums: Mapping[str, Column], time: str) -> DataFrame:
    """df with the sum of each of sums over the key up to the row in order of time."""
    upto = Window.partitionBy(*keys).orderBy(time).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({name: F.sum(x).over(upto) for name, x in sums.items()})


def _columns(df: DataFrame, group: str, weight: str | None, time: str) -> list[Column]:
    """The aggregates of the group's catalog entries that df has the raw column for, but for those of event times."""
    out = []
    for g, _, raws, functions in blocks():
        for raw in raws if g == group else ():
            if raw not in df.columns:
                continue
            x = _number(raw)
            made = {n: f(x) for n, f in X.FUNCTIONS.items()}
            if f"_s_{raw}" in df.columns:
                made["mean"] = F.try_divide(F.max_by(f"_s_{raw}", time), F.count(x))
            if f"_c_{raw}" in df.columns:
                made["wmean"], made["wstd"] = _weighted(x, F.col(weight), F.col(f"_c_{raw}"))
            if f"_p_{raw}" in df.columns:
                made["wmean"] = F.try_divide(F.max_by(f"_p_{raw}", time), F.max_by(f"_w_{raw}", time))
            out += [made[f].cast("double").alias(f"{raw}_{f}") for f in functions if f in made]
    return out


def derived(tables: Mapping[str, DataFrame], keys: Sequence[str], weights: Mapping[str, str] | None = None, time: str = "idx") -> DataFrame:
    """(keys, group, subgroup, feature, metric, data): a row for each catalog entry and each key of any table.

    tables maps groups to their raw tables. A group, or a raw column, that is missing gives null data, as keys without
    rows in a group do. weights names the column of segment lengths of acoustic_seg and audio_seg; pauses are summed over audio_seg.
    Each group is one aggregation; weighted deviations are taken about the plain means of a first one. Means and shares of tables with
    the column time add up in its order, so that their last digit is the same in every run.
    """
    weights, found, pauses = weights or {}, [], ("aco_pausetime", "aco_totaltime", "aco_numpauses")
    for group, df in tables.items():
        weighed = [raw for g, _, raws, functions in blocks() if g == group and "wmean" in functions for raw in raws if raw in df.columns]
        if group in weights and weighed:
            df = _centred(df, keys, weighed)
        means = [raw for g, _, raws, functions in blocks() if g == group and "mean" in functions for raw in raws if raw in df.columns]
        paused = group == "audio_seg" and set(pauses) <= set(df.columns)
        if time in df.columns:
            sums = {f"_s_{raw}": _number(raw) for raw in means}
            for raw in weighed if group in weights else ():
                sums |= {f"_p_{raw}": _number(raw) * F.col(weights[group]), f"_w_{raw}": F.when(_number(raw).isNotNull(), F.col(weights[group]))}
            sums |= {f"_s_{c}": F.col(c) for c in pauses if paused}
            df = _summed(df, keys, sums, time) if sums else df
        columns = _columns(df, group, weights.get(group), time)
        if paused:
            total = {c: F.max_by(f"_s_{c}", time) if time in df.columns else F.sum(c) for c in pauses}
            columns += [x.cast("double").alias(f"{c}_mean") for c, x in total.items()]
            columns.append(F.try_divide(total["aco_pausetime"], total["aco_totaltime"]).cast("double").alias("aco_pausefrac_mean"))
        if columns:
            wide = df.groupBy(*keys).agg(*columns)
            found.append(wide.unpivot(list(keys), [c for c in wide.columns if c not in keys], "name", "data"))
        if group == "movement" and "mov_eyeblink" in df.columns:
            own = df.withColumn("session_id", F.struct(*keys))
            both = X.per_minute(own, "mov_eyeblink", time).join(X.gaps(own, F.col("mov_eyeblink") > 0, time), "session_id", "left")
            both = both.select("session_id.*", *(F.col(c).cast("double").alias(f"mov_eyeblink_{c}") for c in ("count", "dur_mean", "dur_std")))
            found.append(both.unpivot(list(keys), [c for c in both.columns if c not in keys], "name", "data"))
    names = F.array(*(F.struct(*(F.lit(v).cast("string").alias(n) for n, v in zip(("group", "subgroup", "feature", "metric", "name"), (label, sub, feature, metric, f"{raw}_{f}"), strict=True))) for _, _, raw, f, label, sub, feature, metric in entries()))
    who = reduce(DataFrame.unionByName, (df.select(*keys) for df in tables.values())).distinct()
    grid = who.select(*keys, F.inline(names))
    rows = reduce(DataFrame.unionByName, found) if found else who.select(*keys, F.lit(None).cast("string").alias("name"), F.lit(None).cast("double").alias("data"))
    return grid.join(rows, [*keys, "name"], "left").select(*keys, "group", "subgroup", "feature", "metric", "data")


def filled(rows: DataFrame) -> DataFrame:
    """(grp, block, raw, function, label, subgroup, feature, metric, sessions): the catalog as a table, with the number of keys that have data in the rows of `derived`."""
    counts = rows.groupBy(F.col("group").alias("label"), "feature", "metric").agg(F.count("data").alias("sessions"))
    table = rows.sparkSession.createDataFrame(entries(), "grp string, block int, raw string, function string, label string, subgroup string, feature string, metric string")
    return F.broadcast(table).join(counts, ["label", "feature", "metric"]).select("grp", "block", "raw", "function", "label", "subgroup", "feature", "metric", "sessions")


def structure_of(catalog: DataFrame) -> DataFrame:
    """(grp, blocks, columns, filled) of the table `filled`."""
    return catalog.groupBy("grp").agg(F.count_distinct("block").alias("blocks"), F.count(F.lit(1)).alias("columns"), F.count_if(F.col("sessions") > 0).alias("filled"))
