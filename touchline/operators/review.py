"""Ranked review queue: confidence, automatic status, budgets and decisions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.config import DEFAULT, Config
from touchline.functions.columns import listed
from touchline.operators.contacts import hotspots

ACCEPT, HIDE, REVIEW = "auto_accept", "auto_hide", "review"
ACCEPT_CONF, HIDE_CONF, CARRY_FLOOR, NEUTRAL, REJECT_MAX, ANCHOR_MIN = 0.85, 0.15, 0.70, 0.5, 0.35, 0.6


def confidence(app: Column, prior: Column, in_chain: Column) -> Column:
    """Appearance times prior; a weak appearance firmly inside the reach of a chain is carried to a floor."""
    product = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(app, F.lit(NEUTRAL)) * prior))
    weak = app.isNull() | (app < ANCHOR_MIN)
    return F.when(in_chain & (prior >= 1.0) & weak, F.greatest(product, F.lit(CARRY_FLOOR))).otherwise(product)


def negative_evidence(app: Column, prior: Column, had_anchor: Column, dt: Column, is_mine: Column, cfg: Config = DEFAULT) -> Column:
    """Measured reasons against an identity; what could not be measured is never one."""
    return listed(
        (app.isNotNull() & (app < REJECT_MAX), "appearance_mismatch"),
        (had_anchor & (prior <= cfg.orbital_floor + 1e-9) & (dt <= cfg.orbital_max_gap_sec), "outside_orbital"),
        (is_mine.isNotNull() & ~is_mine, "other_team"),
    )


def status(conf: Column, linked: Column, evidence: Column) -> Column:
    return F.when((conf >= ACCEPT_CONF) & linked, ACCEPT).when((conf <= HIDE_CONF) | (F.size(evidence) > 0), HIDE).otherwise(REVIEW)


def montage(scored: DataFrame, cfg: Config = DEFAULT, pad: float = 1.0, half: float = 120.0) -> DataFrame:
    """Rank by confidence within a match, clip windows and crops, status and the decision that a status implies."""
    rank = F.row_number().over(Window.partitionBy("match_id").orderBy(F.desc("conf"), "t_ms", "contact_id")) - 1
    own = status(F.col("conf"), F.col("linked"), F.col("evidence"))
    decision = F.when(own == ACCEPT, "me").when(own == HIDE, "not_me")
    out = scored.withColumns({"rank": rank, "status": F.when(F.col("crowded"), REVIEW).otherwise(own), "own": own, "decision": decision})
    out = out.withColumns({"clip_start_sec": F.greatest(F.lit(0.0), F.col("t_ms") / 1000.0 - pad), "clip_end_sec": F.col("t_ms") / 1000.0 + pad})
    if "duration_sec" in out.columns:
        out = out.withColumn("clip_end_sec", F.least("clip_end_sec", F.coalesce("duration_sec", "clip_end_sec")))
    if {"x", "y"} <= set(out.columns):
        out = out.withColumn("crop", F.array(F.col("x") - half, F.col("y") - half, F.col("x") + half, F.col("y") + half))
    return out


def budgets(items: DataFrame, ordinary: int, crowded: int) -> DataFrame:
    """Review places in rank order, with one budget for ordinary and one for crowded contacts; those beyond fall back."""
    w = Window.partitionBy("match_id", "crowded").orderBy("rank")
    place = F.sum(F.when(F.col("status") == REVIEW, 1).otherwise(0)).over(w)
    over = (F.col("status") == REVIEW) & (place > F.when(F.col("crowded"), crowded).otherwise(ordinary))
    back = F.when(F.col("crowded") & (F.col("own") != REVIEW), F.col("own")).otherwise(HIDE)
    decision = F.when(over & F.col("crowded") & (F.col("own") != REVIEW), F.col("decision")).when(over, "not_me").otherwise(F.col("decision"))
    return items.withColumns({"status": F.when(over, back).otherwise(F.col("status")), "decision": decision})


def apply_decisions(items: DataFrame, decisions: DataFrame, strict: bool = False) -> DataFrame:
    """Decisions (match_id, rank, choice, seq) override by rank, the last of each rank.

    Choices other than me and not_me are ignored, or stop the query if ``strict``."""
    valid = F.col("choice").isin("me", "not_me")
    if strict:
        known = F.when(valid, F.col("choice")).otherwise(F.raise_error(F.concat(F.lit("decision must be me or not_me, got "), F.coalesce("choice", F.lit("null")))))
        decisions = decisions.withColumn("choice", known)
    last = decisions.filter(F.lit(True) if strict else valid).groupBy("match_id", "rank").agg(F.max_by("choice", "seq").alias("choice"))
    return items.join(last, ["match_id", "rank"], "left").withColumn("decision", F.coalesce("choice", "decision")).drop("choice")


def decided_hotspots(items: DataFrame, decisions: DataFrame, samples: DataFrame, durations: DataFrame | None = None, cfg: Config = DEFAULT) -> DataFrame:
    """Hotspots of all contacts that are the target's after the user's decisions; items are (match_id, rank, contact_id, t_ms, decision)."""
    mine = apply_decisions(items, decisions).filter("decision = 'me'")
    return hotspots(mine.withColumn("frame_index", F.col("contact_id")), cfg, samples, durations)


def settled_by(items: DataFrame, rank: int, choice: str) -> DataFrame:
    """Queue items after one decision: ``decision`` of the decided one and of all later ones that it settles, and ``auto`` for those.

    Not me on the other team settles that team's same kit; within the own kit a look-alike group is settled either way; crowded items
    neither give nor take. Items are (match_id, rank, crowded, is_other_team, kit_group, appearance_group, decision)."""
    given = items.filter(F.col("rank") == rank).select("match_id", *[F.col(c).alias(f"g_{c}") for c in ("crowded", "is_other_team", "kit_group", "appearance_group")])
    both = items.join(given, "match_id", "left")
    hard = F.lit(choice == "not_me") & F.col("g_is_other_team") & F.col("is_other_team") & (F.col("kit_group") >= 0) & (F.col("kit_group") == F.col("g_kit_group"))
    soft = ~F.col("g_is_other_team") & ~F.col("is_other_team") & (F.col("appearance_group") >= 0) & (F.col("appearance_group") == F.col("g_appearance_group"))
    auto = F.coalesce((F.col("rank") > rank) & F.col("decision").isNull() & ~F.col("crowded") & ~F.col("g_crowded") & (hard | soft), F.lit(False))
    out = both.withColumns({"auto": auto, "decision": F.when((F.col("rank") == rank) | auto, choice).otherwise(F.col("decision"))})
    return out.select(*items.columns, "auto")


def replayed(items: DataFrame, log: DataFrame) -> DataFrame:
    """``match_id, rank, decision, settled_by`` after a log of choices (match_id, seq, choice: me, not_me or undo).

    Items without a decision wait in the order of their ranks. A choice decides the one in front and settles those waiting ones that
    ``settled_by`` would, which leave the queue; undo puts what the last choice settled back in front, undecided, in its order, once. A
    later choice so meets only what earlier ones have left, and falls silent on an empty queue. ``settled_by`` is the rank whose decision
    settled an item by itself.

    Folded per match over its review queue, which budgets bound before, and its choices; each choice looks at its own group only."""

    def fold(key: tuple, queue: pd.DataFrame, choices: pd.DataFrame) -> pd.DataFrame:
        rows = queue.sort_values("rank").to_dict("records")
        items = {r["rank"]: r for r in rows}
        groups: dict[tuple, list[int]] = {}
        for r in rows:
            for kind in _kinds(r):
                groups.setdefault(kind, []).append(r["rank"])
        front: list[int] = []  # taken back, before all others
        waiting = [r["rank"] for r in rows if r["decision"] is None]
        open_, at, last = set(waiting), 0, []
        by: dict[int, int] = {}
        for choice in choices.sort_values("seq")["choice"]:
            if choice == "undo":
                for rank in last:
                    items[rank]["decision"] = None
                    by.pop(rank)
                    open_.add(rank)
                front, last = last + front, []
                continue
            if choice not in ("me", "not_me"):
                continue
            front = [r for r in front if r in open_]
            while at < len(waiting) and (waiting[at] not in open_ or waiting[at] in front):
                at += 1
            if not front and at == len(waiting):
                continue
            own = items[front[0] if front else waiting[at]]
            open_.discard(own["rank"])
            own["decision"] = choice
            place = {r: k for k, r in enumerate(front)}
            found = [r for kind in _kinds(own) if kind[0] == "look" or choice == "not_me" for r in groups[kind] if r in open_]
            last = sorted(found, key=lambda r: (place.get(r, len(place)), r))
            for rank in last:
                items[rank]["decision"], by[rank] = choice, own["rank"]
                open_.discard(rank)
        out = [(r["match_id"], r["rank"], r["decision"], by.get(r["rank"])) for r in rows]
        return pd.DataFrame(out, columns=["match_id", "rank", "decision", "settled_by"])

    columns = ["match_id", "rank", "crowded", "is_other_team", "kit_group", "appearance_group", "decision"]
    return items.select(*columns).groupBy("match_id").cogroup(log.select("match_id", "seq", "choice").groupBy("match_id")).applyInPandas(fold, "match_id long, rank int, decision string, settled_by int")


def _kinds(item: dict) -> list[tuple]:
    """The groups through which an item gives and takes decisions."""
    if item["crowded"]:
        return []
    if item["is_other_team"]:
        return [("kit", item["kit_group"])] if item["kit_group"] >= 0 else []
    return [("look", item["appearance_group"])] if item["appearance_group"] >= 0 else []


def undone(items: DataFrame) -> DataFrame:
    """Items with what the last decision settled by itself taken back; the decision itself stays."""
    return items.withColumn("decision", F.when(~F.col("auto"), F.col("decision"))).drop("auto")


def propagate(items: DataFrame) -> DataFrame:
    """Decisions passed on to later items of the same group (match_id, grp, rank, crowded, decision); crowded ones neither give nor take."""
    first = F.min(F.when((F.col("decision") == "me") & ~F.col("crowded"), F.col("rank"))).over(Window.partitionBy("match_id", "grp"))
    return items.withColumn("giver", first).withColumn("decision", F.coalesce("decision", F.when((F.col("giver") < F.col("rank")) & ~F.col("crowded"), "me"))).drop("giver")
