"""From session files to stored tables and signals."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.joins import keep_matching
from ..functions.ordered import HeavyKeys, heavy_keys
from ..functions.scratch import written
from ..functions.text import scrub
from ..operators import parse
from ..operators.incremental import ingest_stats, new_manifest, select_new
from ..operators.payloads import build_payloads
from ..operators.recurring import signal_correction_clusters, signal_repeated_path_fixes, tools_before_corrections
from ..operators.sequences import recurring_of, sequences_by_project, signal_recurring_sequences, tool_sequences
from ..operators.skills import (
    signal_skill_abandoned, signal_skill_eligible_missed, signal_skill_turnaround,
)
from ..operators.tokens import (
    signal_bloat, signal_compaction_proximity, signal_oversized_agent, signal_redundant_reads,
)
from ..schemas import (
    FILES, LINES, PARTS, SESSION_SIGNALS, SESSIONS, SIGNALS, SKILL_INVOCATIONS, TOOL_SEQUENCES, USER_MESSAGES, columns_of,
    conform,
)
from ..sources.jsonl import path_facts
from ..sources.signatures import load_signatures, longest
from ..sources.store import BUCKET, DAY, SessionStore, day_of, few_rows
from ..sources.tails import RANGE_BYTES, changed_files, list_files, read_tails


def _grown(new: DataFrame, work: DataFrame, stored: SessionStore) -> DataFrame:
    """``new`` lines, and those stored of files that were read on from a place."""
    facts = path_facts(F.col("path"))
    onwards = work.filter("start > 0").select("path", "start", facts["session_id"].alias("session_id"))
    if onwards.isEmpty():
        return new
    pieces = stored.places(keep_matching(stored.pieces("sessions"), onwards, ["session_id"]))
    lines = stored.pieces("lines", pieces).join(onwards.drop("session_id"), "path").filter("line < start")
    return new.unionByName(lines.select(*new.columns))


def _new_files(work: DataFrame, known: DataFrame, fresh: DataFrame) -> DataFrame:
    """The table of files after a load.

    A file whose lines are not stored, as it does not hold the latest of its session, is to be read
    from its old place again when it changes, or from its start if it gave way to another file.
    """
    facts = path_facts(F.col("path"))
    loaded = fresh.select("path", F.lit(True).alias("loaded"))
    ways = fresh.select("session_id", F.lit(True).alias("replaced"))
    old = known.select("path", F.col("place").alias("old_place"), F.col("mark").alias("old_mark"))
    seen = work.withColumn("session_id", facts["session_id"]).join(old, "path", "left").withColumns(
        {"new_place": F.col("place"), "new_mark": F.col("mark"), "place": F.coalesce("old_place", F.lit(0)),
         "mark": F.coalesce("old_mark", F.lit(""))})
    rest = known.join(work.select("path"), "path", "left_anti").withColumns(
        {"new_place": F.col("place"), "new_mark": F.col("mark")})
    names = ["path", "session_id", "size", "modified", "place", "mark", "new_place", "new_mark"]
    rows = seen.select(*names).unionByName(rest.select(*names))
    rows = rows.join(loaded, "path", "left").join(ways, "session_id", "left")
    pick = lambda c, none: F.when(F.col("loaded"), F.col(f"new_{c}")).when(F.col("replaced"), F.lit(none)).otherwise(F.col(c))
    return conform(rows.withColumns({"place": pick("place", 0), "mark": pick("mark", "")}), FILES)


def _redacted(lines: DataFrame) -> DataFrame:
    """Parsed lines as they are stored."""
    message = F.when(F.col("message").isNotNull(), F.struct("message.ts", scrub(F.col("message.text")).alias("text")))
    return lines.withColumns({
        "text_head": scrub(F.col("text_head")), "message": message,
        "blocks": F.transform("blocks", lambda b: b.withField("args_json", scrub(b.args_json)))})


def ingest(spark: SparkSession, projects_root: str, store: SessionStore, home_prefix: str = "",
           home: str = "", pair_by: str = "order", scrub_first: bool = False,
           full_args: bool = False, modified_after: str | None = None,
           range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Load new and grown sessions; returns the counts (sessions_ingested, skipped, total).

    Files that are as they were are not opened, and of a grown one only what it gained is read
    and parsed; the tables of its session come from its stored and its new lines.  All tables change in one
    version, so a run that broke off is simply run again.  ``full_args`` keeps whole arguments for
    the payloads; ``scrub_first`` redacts before cutting, not after.  ``modified_after`` looks only at files
    changed since then, and counts only those.
    """
    stored = store.snapshot()
    known = stored.files()
    listed = written(list_files(spark, projects_root, modified_after=modified_after))
    work = written(changed_files(listed, known))
    args_chars = None if full_args or scrub_first else parse.ARGS_CHARS
    # Every new line is parsed once; all tables derive from this one.
    lines = read_tails(work, range_bytes).withColumn("block", F.lit(""))
    parsed = _grown(written(parse.parse_lines(lines, args_chars, scrub_first).drop("block")), work, stored)
    # The line order of a file is its lines' byte offsets; blocks only cut long files.
    long = work.filter(F.col("size") > range_bytes).select("path", F.lit(True).alias("long"))
    split = not long.isEmpty()
    block = F.lit("")
    if split:
        block = F.when(F.col("long"), F.lpad(F.floor(F.col("line") / range_bytes).cast("string"), 20, "0")).otherwise("")
        parsed = parsed.join(long, "path", "left")
    parsed = written(parsed.withColumn("block", block).drop("long"))
    files = written(parse.session_rollup(parsed, home_prefix, home))
    manifest = stored.manifest()
    untouched = listed.join(work.select("path"), "path", "left_anti").agg(F.count(F.lit(1)).alias("kept"))
    stats = written(ingest_stats(files, manifest).crossJoin(untouched).select(
        "sessions_ingested", (F.col("skipped") + F.col("kept")).alias("skipped"), (F.col("total") + F.col("kept")).alias("total")))
    fresh = written(select_new(files, manifest).withColumn(DAY, day_of(F.col("started_at"))))
    new_files = _new_files(work, known, fresh)
    replaced = fresh.select("session_id", DAY)
    if fresh.isEmpty():
        if not work.isEmpty():
            store.overwrite("files", new_files)
        return stats

    mine = keep_matching(parsed, fresh, ["path"])
    positioned = written(parse.with_positions(mine, split, home_prefix))
    calls = parse.tool_calls(positioned, split, pair_by)
    if not full_args:
        calls = calls.withColumn("args_json", F.substring("args_json", 1, parse.ARGS_CHARS)) if scrub_first else calls
    calls = written(calls)
    heavy = heavy_keys(positioned, "path")
    skills = parse.skill_invocations(positioned, calls, heavy)
    of_day = lambda df: df.join(replaced, "session_id")
    stored_calls = parse.conform_calls(calls)
    by_session = HeavyKeys((), heavy.block_rows) if not heavy.keys else None
    facts = path_facts(F.col("path"), home_prefix)
    store.add_payloads(build_payloads(calls, existing=store.payloads()))
    messages = parse.user_messages(mine, home_prefix, home).withColumns(
        {"is_subagent": facts["is_subagent"], "text": scrub(F.col("text"))})
    store.replace(
        {
            "sessions": conform(fresh, {**SESSIONS, DAY: "string"}),
            "events": of_day(parse.normalize_events(positioned)),
            "tool_calls": of_day(stored_calls),
            "skill_invocations": of_day(conform(skills, SKILL_INVOCATIONS)),
            "tool_sequences": of_day(conform(tool_sequences(stored_calls, heavy=by_session), TOOL_SEQUENCES)),
            "user_messages": of_day(conform(messages, USER_MESSAGES)),
            "lines": of_day(conform(_redacted(mine).withColumn("session_id", facts["session_id"]), LINES)),
        },
        replaced,
        whole={"manifest": new_manifest(manifest, fresh), "files": new_files},
    )
    return stats


def signals(sessions: DataFrame, events: DataFrame, calls: DataFrame, skills: DataFrame,
            sequences: DataFrame, signatures: Mapping[str, Mapping] | None,
            heavy: HeavyKeys | None = None, max_distance: int | None = None) -> dict[str, DataFrame]:
    """All signal tables of the base tables; without signatures no skill signals."""
    if heavy is None:
        heavy = heavy_keys(events)
    out = {
        "signal_bloat": signal_bloat(calls, events, heavy),
        "signal_compaction_proximity": signal_compaction_proximity(events, heavy=heavy),
        "signal_redundant_reads": signal_redundant_reads(calls, heavy),
        "signal_oversized_agent": signal_oversized_agent(calls),
        "signal_recurring_sequences": signal_recurring_sequences(sequences, sessions),
        "signal_correction_clusters": signal_correction_clusters(events, calls, heavy),
        "signal_repeated_path_fixes": signal_repeated_path_fixes(calls, max_distance, heavy),
    }
    if signatures is not None:
        sigs = load_signatures(events.sparkSession, signatures)
        out |= {
            "signal_skill_eligible_missed": signal_skill_eligible_missed(
                calls, skills, sigs, longest(signatures), heavy),
            "signal_skill_abandoned": signal_skill_abandoned(skills, events, heavy),
            "signal_skill_turnaround": signal_skill_turnaround(skills, events, heavy),
        }
    return out


def _signed(totals: DataFrame, old: DataFrame, new: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Totals less the old parts plus the new ones."""
    signed = old.withColumn(value, -F.col(value))
    rows = totals.unionByName(signed.select(*totals.columns)).unionByName(new.select(*totals.columns))
    return rows.groupBy(*keys).agg(F.sum(value).alias(value)).filter(F.col(value) > 0)


def derive(store: SessionStore, signatures: Mapping[str, Mapping] | None,
           max_distance: int | None = None) -> int:
    """Bring all signal tables up to date, in one version; the number of pieces looked at.

    Signals of sessions are kept by piece, and only pieces changed since the last call are read.  What
    counts over all sessions is kept as totals, from which the old counts of these pieces are taken and to which
    the new ones are added.  With other arguments than last time all pieces are read.
    """
    now = store.snapshot()
    params = json.dumps([signatures, max_distance], sort_keys=True, default=str)
    current = [(r.day, r.bucket, r.version, params) for r in now.live() if r.name == "sessions"]
    done = {tuple(r) for r in now.pieces("derived").drop(DAY, BUCKET).collect()}  # one row a piece
    changed = {(r[0], r[1]) for r in current if r not in done}
    if not changed:
        return 0
    t = {n: now.pieces(n, changed).filter("session_id is not null")
         for n in ("sessions", "events", "tool_calls", "skill_invocations", "tool_sequences")}
    plain = {n: df.drop(DAY, BUCKET) for n, df in t.items()}
    where = t["sessions"].select("session_id", DAY, BUCKET)
    heavy = heavy_keys(plain["events"])
    tables = signals(plain["sessions"], plain["events"], plain["tool_calls"], plain["skill_invocations"],
                     plain["tool_sequences"], signatures, heavy, max_distance)
    out = {n: df.join(where, "session_id") for n, df in tables.items() if n in SESSION_SIGNALS}
    out["recurring_parts"] = written(sequences_by_project(plain["tool_sequences"], t["sessions"], DAY, BUCKET))
    before = tools_before_corrections(plain["events"], plain["tool_calls"], heavy)
    out["cluster_parts"] = written(before.join(where, "session_id").groupBy(DAY, BUCKET, "preceding_tools").agg(
        F.count(F.lit(1)).alias("occurrences")))
    old = lambda n: now.pieces(n, changed).filter(F.col(list(PARTS[n])[0]).isNotNull())
    totals = lambda n: now.pieces(n).drop(DAY, BUCKET)
    sequences = written(_signed(totals("recurring_totals"), old("recurring_parts"), out["recurring_parts"],
                                ["sequence", "n", "project"], "sessions"))
    clusters = written(_signed(totals("cluster_totals"), old("cluster_parts"), out["cluster_parts"],
                               ["preceding_tools"], "occurrences"))
    store.put_pieces(
        {n: conform(df, {**(PARTS.get(n) or columns_of(SIGNALS[n])), DAY: "string", BUCKET: "int"}) for n, df in out.items()},
        changed,
        whole={
            "recurring_totals": sequences, "cluster_totals": clusters,
            "derived": few_rows(store.spark, current, ", ".join(f"{c} {k}" for c, k in PARTS["derived"].items())),
            "signal_recurring_sequences": recurring_of(sequences),
            "signal_correction_clusters": clusters.withColumn("occurrences", F.col("occurrences").cast("int")),
        },
    )
    return len(changed)
