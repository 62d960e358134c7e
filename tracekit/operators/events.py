"""Event logs: JSON records decoded into typed events, cues, lap plans and device settings; times of omitted events; pulses and segment numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracekit.functions.scalars import PINS

# Keys of a record for events and for positions, and the pin of the reward valve.
EVENT, POSITION = "127.0.0.1:5015", "127.0.0.1:5025"
REWARD_PIN = 5
# Locations of the cues in the lap plans that have a name.
BOTH, SWITCHED = [500, 1300], [1300, 500]
THREE = {("CUE1", "LED", "TONE"): ([500, 1500, 1000], "toneNcueNled"), ("CUE1", "LED"): ([1500, 1000], "cueNled"), ("CUE1", "TONE"): ([500, 1500], "toneNcue"), ("LED", "TONE"): ([500, 1000], "toneNled")}
# What a lap is by (largest location number, number of cues) and the location numbers of its cues in the order of their names.
LAP_RULES = [
    (2, 2, [0, 2], "OMITCUE1"), (2, 2, [1, 0], "OMITCUE2"), (2, 2, [0, 0], "OMITBOTH"), (2, 2, [2, 1], "SWITCH"),
    (1, 2, [0, 1], "OMITFIRST"), (1, 2, [1, 0], "OMITLAST"), (1, 2, [0, 0], "OMITBOTH"),
    (1, 1, [0], "OMITCUE1"), (2, 1, [2], "OMITCUE1_L1"), (2, 1, [1], "OMITCUE1_L2"), (2, 1, [0], "OMITBOTH"),
    (1, 3, [0, 0, 0], "OMITALL"), (1, 3, [1, 1, 0], "OMITTONE"), (1, 3, [1, 0, 1], "OMITLED"), (1, 3, [0, 1, 1], "OMITCUE1"),
]


def carried_records(raw: DataFrame, session: str, line: str, json: str) -> DataFrame:
    """(session, line, record, t, pos, lap): the parsed records (variants) of each session in order, with the last position and lap seen by then; records that are no JSON, or whose time is under one before, are left out."""
    v = F.try_parse_json(json)
    rows = raw.select(session, line, v.alias("record")).where("record is not null")
    at = lambda path, kind: F.try_variant_get("record", path, kind)
    w = Window.partitionBy(session).orderBy(line)
    rows = rows.withColumn("t", at("$.time", "double")).withColumn("_m", F.max("t").over(w.rowsBetween(Window.unboundedPreceding, -1))).where("_m is null or t is null or t >= _m")
    known = w.rowsBetween(Window.unboundedPreceding, 0)
    moved = at(f"$['{POSITION}']", "variant").isNotNull()
    return rows.select(session, line, "record", "t", F.last(F.when(moved, at("$.y", "double")), ignorenulls=True).over(known).alias("pos"), F.last(at("$.lap", "long"), ignorenulls=True).over(known).alias("lap"))


def device_settings(raw: DataFrame, session: str, line: str, json: str) -> DataFrame:
    """(session, sync_pin, led_pin, info): the last settings of each session that say so."""
    at = lambda path, kind: F.try_variant_get(F.try_parse_json(json), path, kind)
    rows = raw.select(session, line, at("$.settings.sync_pin", "int").alias("a"), at("$.settings.led", "int").alias("b"), at("$.sess_info", "string").alias("c"))
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col(line)))
    return rows.groupBy(session).agg(last("a").alias("sync_pin"), last("b").alias("led_pin"), last("c").alias("info"))


def decoded_events(raw: DataFrame, session: str, line: str, json: str, settings: DataFrame, cues: DataFrame) -> DataFrame:
    """(session, line, channel, edge, t, pos, lap, name): what each record tells, one row for each channel.

    Channels are position, lap, tag, context, lick, reward, sync, led and cue. ``settings`` (session, sync_pin, led_pin) and ``cues`` (pin, name) tell what valves
    and tones stand for: opening one is a start, closing one a stop, and a lap belongs to starts only. A tone counts in records without a valve.
    """
    rows = carried_records(raw, session, line, json).join(settings.select(session, "sync_pin", "led_pin"), session, "left")
    at = lambda path, kind="string": F.try_variant_get("record", path, kind)
    event = lambda path, kind="string": at(f"$['{EVENT}'].{path}", kind)
    valve = event("valve.pin", "int")
    pin, action = F.coalesce(valve, event("tone.pin", "int")), F.when(valve.isNotNull(), event("valve.action")).otherwise(event("tone.action"))
    edge = F.when(action == "open", "start").when(action == "close", "stop")
    one = lambda when, channel, edge, name: F.when(when, F.struct(F.lit(channel).alias("channel"), edge.cast("string").alias("edge"), name.cast("string").alias("name")))
    none, moved = F.lit(None).cast("string"), at(f"$['{POSITION}']", "variant").isNotNull()
    turn = event("context.action")
    known = rows.join(F.broadcast(cues.select(F.col("pin").alias("_pin"), F.col("name").alias("_cue"))), pin == F.col("_pin"), "left")
    told = F.array(
        one(moved, "position", none, none), one(at("$.lap", "long").isNotNull(), "lap", none, none), one(event("tag_reader.tag").isNotNull(), "tag", none, event("tag_reader.tag")),
        one(turn.isNotNull(), "context", turn, event("context.id")), one(event("lick", "variant").isNotNull(), "lick", none, none),
        one((valve == REWARD_PIN) & (edge == "start"), "reward", none, none), one((valve == F.col("sync_pin")) & edge.isNotNull(), "sync", edge, none),
        one((valve == F.col("led_pin")) & edge.isNotNull(), "led", edge, none), one(F.col("_cue").isNotNull() & edge.isNotNull(), "cue", edge, F.col("_cue")),
    )
    out = known.select(session, line, "t", "pos", "lap", F.explode(F.filter(told, lambda x: x.isNotNull())).alias("e"))
    stop = F.coalesce(F.col("e.edge") == "stop", F.lit(False))
    return out.select(session, line, "e.channel", "e.edge", "t", "pos", F.when(~stop, F.col("lap")).alias("lap"), "e.name")


def cue_edges(events: DataFrame, session: str, line: str) -> DataFrame:
    """(session, name, edge, n, t, pos, lap): starts and stops of each cue, numbered in order."""
    cue = events.where("channel = 'cue'")
    n = F.row_number().over(Window.partitionBy(session, "name", "edge").orderBy(line))
    return cue.select(session, "name", "edge", n.alias("n"), "t", "pos", "lap")


def sync_times(events: DataFrame, session: str, line: str) -> DataFrame:
    """(session, on, off): times of the last sync pulse's edges."""
    last = lambda edge: F.max_by("t", F.when(F.col("edge") == edge, F.col(line)))
    return events.where("channel = 'sync'").groupBy(session).agg(last("start").alias("on"), last("stop").alias("off"))


def lap_plan(contexts: DataFrame, session: str, names: dict[int, str] | None = None) -> DataFrame:
    """(session, lap, cues, pins, locs, ids, kind) from contexts (session, place, id, valves array<int>, locations array<int>, laps array<int>): what each planned lap holds, in the order of the contexts.

    A context is named by its first valve; contexts without a valve, or with one that has no name, have no cue.
    """
    named = F.create_map(*[F.lit(x) for kv in (names or PINS).items() for x in kv])
    each = contexts.select(session, F.explode("laps").alias("lap"), F.struct("place", F.get("valves", F.lit(0)).alias("v"), "valves", "locations", "id").alias("c"))
    plan = each.groupBy(session, "lap").agg(F.sort_array(F.collect_list("c")).alias("c"))
    cues = F.filter(F.transform("c", lambda c: F.try_element_at(named, c["v"])), lambda x: x.isNotNull())
    out = plan.select(session, "lap", cues.alias("cues"), F.flatten("c.valves").alias("pins"), F.flatten("c.locations").alias("locs"), F.col("c.id").alias("ids"))
    return out.withColumn("kind", lap_plan_type(F.col("pins"), F.col("locs"), names or PINS))


def lap_plan_type(pins: Column, locs: Column, names: dict[int, str]) -> Column:
    """The kind of a lap by its set of pins and its locations in order."""
    by_name = {v: k for k, v in names.items()}
    pin_set = F.array_sort(F.array_distinct(pins))
    pins_are = lambda *cues: pin_set == F.array(*[F.lit(x) for x in sorted(by_name[c] for c in cues)]) if all(c in by_name for c in cues) else F.lit(False)
    locs_are = lambda at: locs == F.array(*[F.lit(x) for x in at])
    out = F.when(pins_are("CUE1", "CUE2") & locs_are(BOTH), "both").when(pins_are("CUE1", "CUE2") & locs_are(SWITCHED), "both_switch")
    for cues, (at, kind) in THREE.items():
        out = out.when(pins_are(*cues) & locs_are(at), kind)
    for cue, single, double in (("CUE1", "CUE1", "both_c1"), ("CUE2", "CUE2", "both_c2")):
        out = out.when(pins_are(cue) & (F.size(locs) == 1), single).when(pins_are(cue) & (F.size(locs) == 2), double)
    return out.otherwise("unknown")


def cue_with_stimulus(events: DataFrame, k: list[str], t: str, kind: str, cue: str, stimulus: str, gap: float = 1.0) -> DataFrame:
    """(k, t, pairing): ``plain`` cues, and cues ``with`` a stimulus right before them, that is one ``gap`` earlier when rounded.

    A cue is plain if a stimulus comes next, or nothing, or a cue, unless a stimulus stands right before it. One that follows a stimulus closely and is followed by another counts as both.
    """
    w = Window.partitionBy(*k).orderBy(t)
    both = events.where(F.col(kind).isin(cue, stimulus)).withColumn("_n", F.lead(kind).over(w)).withColumn("_p", F.lag(kind).over(w)).withColumn("_d", F.bround((F.col(t) - F.lag(t).over(w)) / gap))
    own = both.where(F.col(kind) == cue)
    close = F.coalesce((F.col("_p") == stimulus) & (F.col("_d") == 1), F.lit(False))
    plain = F.col("_n").isNull() | (F.col("_n") == stimulus) | ~close
    kinds = F.filter(F.array(F.when(plain, "plain"), F.when(close, "with")), lambda x: x.isNotNull())
    return own.select(*k, t, F.explode(kinds).alias("pairing"))


def lap_kinds(bins: DataFrame, session: str, lap: str, cue: str, at: str, rules: DataFrame) -> DataFrame:
    """(session, lap, kind): laps told by the location numbers of their cues (0: not there), by rules (most, cues, at, kind); others are left out.

    bins (session, lap, cue, at) has a row for each lap and cue of the session's cues that occur at all.
    """
    whole = bins.groupBy(session).agg(F.max(at).alias("most"), F.count_distinct(cue).alias("cues"))
    laps = bins.groupBy(session, lap).agg(F.sort_array(F.collect_list(F.struct(cue, at)))[at].alias("at"))
    return laps.join(whole, session).join(F.broadcast(rules), ["most", "cues", "at"]).select(session, lap, "kind")


def imputed_times(frames: DataFrame, laps: DataFrame, k: list[str], lap: str, centres: DataFrame, o: str, pos: str, t: str) -> DataFrame:
    """(k, lap, cue, t): for each of ``laps`` (k, lap, cue) the time of its first frame whose position is over the cue's centre (cue, centre); laps that never get there are left out."""
    asked = laps.join(F.broadcast(centres), "cue")
    return frames.join(asked, [*k, lap]).where(F.col(pos) > F.col("centre")).groupBy(*k, lap, "cue").agg(F.min_by(t, o).alias(t))


def with_imputed(events: DataFrame, imputed: DataFrame) -> DataFrame:
    """Events and imputed ones with a time, told apart by ``imputed``."""
    return events.withColumn("imputed", F.lit(False)).unionByName(imputed.where("t is not null").withColumn("imputed", F.lit(True)))


def reconciled_segments(recorded: DataFrame, computed: DataFrame, k: list[str]) -> DataFrame:
    """(k, n, segment): the numbers of ``computed`` (k, n, segment) for series where it has more of them, else those of ``recorded``."""
    size = lambda df, name: df.where("segment is not null").groupBy(*k).agg(F.count("*").alias(name))
    use = size(recorded, "_r").join(size(computed, "_c"), k, "full_outer").select(*k, (F.coalesce("_c", F.lit(0)) > F.coalesce("_r", F.lit(0))).alias("_use"))
    pick = lambda df, flag: df.where("segment is not null").join(use, k).where(flag).select(*k, "n", "segment")
    return pick(computed, "_use").unionByName(pick(recorded, "not _use"))


def dominant_type(events: DataFrame, kind: str, lap: str) -> DataFrame:
    """(kind, n, laps array): the most frequent kind, the first by name on ties, with the laps of its events counted from 1."""
    n = events.groupBy(kind).agg(F.count("*").alias("n")).orderBy(F.desc("n"), kind).limit(1)
    base = events.agg(F.min(lap).alias("_low"))
    own = events.join(F.broadcast(n), kind).crossJoin(F.broadcast(base))
    return own.groupBy(kind, "n").agg(F.sort_array(F.collect_set(F.col(lap) - F.col("_low") + 1)).alias("laps"))
