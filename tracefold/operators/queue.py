"""The fair, bounded queue of topics to distil."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracefold import fixed_values as fv
from tracefold.functions import topics as t
from tracefold.functions.dates import hours_after
from tracefold.functions.projects import topic_project_label
from tracefold.functions.text import blank_to_null
from tracefold.operators.identity import numbered_families
from tracefold.operators.outcomes import match_settlements, reusable_settlement
from tracefold.operators.sequence import RANGE, first_rows, previous_value, range_blocks, running_total
from tracefold.session import cut_lineage

LANES = ["retry", "backlog", "recent"]


# --- which pairs count ---------------------------------------------------------------------------
def classify_pairs(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("automation", t.automation_class(F.col("prompt_content"), F.col("stop_content")))


def supporting_pairs(pairs: DataFrame, titles: DataFrame | None) -> DataFrame:
    """Pairs of internal helper sessions: signed like one and absent from an available index."""
    prompt = F.col("prompt_content")
    signed = (F.col("source") == "codex") & prompt.rlike(fv.SUPPORTING_OPENING) & prompt.rlike(fv.SUPPORTING_SIGNATURE)
    if titles is None:
        return pairs.where(F.lit(False))
    return pairs.where(signed).join(titles.select("session_id").distinct(), "session_id", "left_anti")


def pending_pairs(
    pairs: DataFrame, processed: DataFrame, ledger: DataFrame | None = None, ledger_events: DataFrame | None = None,
    since: str | None = None, backfill: bool = False,
) -> DataFrame:
    """Ids of pairs with an unprocessed source event, or, in a backfill, an unsettled one."""
    kept = pairs if since is None else pairs.where(F.col("date") >= F.lit(since).cast("date"))
    events = kept.select("id", F.explode("source_event_ids").alias("event_id"))
    open_ = events.join(processed.select("event_id").distinct(), "event_id", "left_anti")
    if backfill:
        done = ledger.where(F.col("status").isin("succeeded", "not-applicable")).select(F.col("id").alias("settlement_id"))
        settled = ledger_events.join(done, "settlement_id", "left_semi").select("event_id").distinct()
        open_ = open_.unionByName(events.join(settled, "event_id", "left_anti"))
    return open_.select("id").distinct()


def mark_pending(pairs: DataFrame, pending: DataFrame) -> DataFrame:
    flag = pending.select("id", F.lit(True).alias("pending"))
    return pairs.join(flag, "id", "left").withColumn("pending", F.coalesce("pending", F.lit(False)))


def sort_pairs(pairs: DataFrame, titles: DataFrame | None) -> DataFrame:
    """Each pair with its queue class: no-op, substantive, supporting or candidate."""
    classed = classify_pairs(pairs)
    helper = supporting_pairs(pairs, titles).select("id", F.lit(True).alias("helper"))
    joined = classed.join(helper, "id", "left")
    kind = (
        F.when(F.col("automation") != "ordinary", F.col("automation"))
        .when(F.coalesce("helper", F.lit(False)), "supporting")
        .otherwise("candidate")
    )
    return joined.withColumn("queue_class", kind).drop("helper")


def system_outcomes(sorted_pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows settled without a writer (no-op automation by kind and day, helper sessions by day), and their events."""
    rows = sorted_pairs.where(F.col("pending") & F.col("queue_class").isin("no-op", "supporting"))
    no_op = F.col("queue_class") == "no-op"
    day = F.col("date").cast("string")
    key = F.when(no_op, F.concat_ws(":", t.automation_kind(F.col("prompt_content"), F.col("stop_content")), day)).otherwise(
        F.concat_ws(":", "session_id", day)
    )
    rows = rows.withColumn("group_key", key).withColumn("category", F.when(no_op, "no-op-automation").otherwise("supporting-session"))
    rows = rows.withColumn("outcome_id", F.when(no_op, t.system_outcome_id("no-op-automation", F.col("group_key"))).otherwise(
        t.system_outcome_id("supporting-session", F.col("group_key"))))
    reason = F.when(F.col("category") == "no-op-automation", fv.SYSTEM_REASONS["no-op-automation"]).otherwise(fv.SYSTEM_REASONS["supporting-session"])
    heads = rows.groupBy("outcome_id", "category", "group_key").agg(F.count(F.lit(1)).alias("pair_count")).select(
        F.col("outcome_id").alias("id"), F.lit("not-applicable").alias("status"), "category", "group_key", "pair_count", reason.alias("reason")
    )
    events = rows.select(F.col("outcome_id").alias("settlement_id"), F.explode("source_event_ids").alias("event_id")).distinct()
    return heads, events


# --- segments ------------------------------------------------------------------------------------
def segment_sessions(pairs: DataFrame, titles: DataFrame, blocks: int | None = None) -> DataFrame:
    """Split sessions into topics: each pair with its ``anchor``, ``opens`` and, on opening rows, ``segment_title``.

    The reference walks a session with a current anchor. That anchor is always the last anchor a row
    stated — by naming one or by opening a segment — so it is a last-non-null over the rows before, and
    a row opens a segment when it is the session's first, names another anchor, or sets a new goal.

    Everything read from a pair's text is read before the first shuffle; the rows that move are slim.
    """
    prompt, stop = F.col("prompt_content"), F.col("stop_content")
    session = F.concat_ws(":", "source", F.coalesce(blank_to_null(F.col("session_id")), blank_to_null(F.col("conversation_id")), F.col("id")))
    pairs = pairs.withColumn("session_key", session)
    heads = pairs.groupBy("session_key").agg(F.min(F.struct("captured_at", "id"))["id"].alias("head_id"))
    # A key of its own for rows that have none: they match nothing, and do not meet in one task.
    spread = lambda c: F.coalesce(c, F.concat(F.lit("\u0000"), "id"))
    index = titles.select(F.col("session_id").alias("index_key"), F.col("title").alias("index_title"))
    restored = titles.select(F.col("session_id").alias("restored_key"), F.col("title").alias("restored_title"))
    families = numbered_families(pairs, titles).withColumnRenamed("session_id", "index_key")
    read = pairs.select(
        "*", t.substantive_automation(prompt, stop).alias("automation_name"), t.prompt_title(prompt).alias("stated"),
        spread(t.restored_session(prompt)).alias("restored_key"), spread(F.col("session_id")).alias("index_key"),
    )
    read = read.select(
        "*", t.new_goal(F.col("stated")).alias("goal"), t.is_short_continuation(F.col("stated")).alias("short"),
        t.explicit_anchor(F.col("automation_name")).alias("explicit"),
    )
    kept = [
        "id", "session_key", "session_id", "source", "captured_at", "date", "source_event_ids", *(["pending"] if "pending" in pairs.columns else []),
    ]
    slim = read.select(
        *kept, topic_project_label(F.col("source"), F.col("cwd")).alias("project"), t.pair_chars().alias("chars"),
        F.array(*t.priority_flags(prompt, stop)).alias("flags"), "explicit", "goal", "stated", "short", "automation_name", "restored_key", "index_key",
        t.topic_title(F.lit(None).cast("string"), F.col("automation_name")).alias("own_title"),
        ((F.col("goal").isNotNull() | t.is_delegation(prompt)) & ~F.col("short")).alias("asks_anew"),
        t.segment_anchor(F.col("goal"), F.lit(True)).alias("base_anchor"), t.segment_anchor(F.col("goal"), F.lit(False)).alias("goal_anchor"),
    )
    rows = slim.join(index, "index_key", "left").join(restored, "restored_key", "left").join(families, "index_key", "left").join(heads, "session_key")
    rows = rows.withColumn("named", t.segment_title(
        F.col("index_title"), F.col("restored_title"), F.col("goal"), F.col("stated"), F.col("short"), F.col("automation_name"), F.col("own_title")
    ))
    first = F.col("id") == F.col("head_id")
    own = F.coalesce(
        "explicit", F.when(first, F.coalesce("family_anchor", "base_anchor")), F.when(F.col("asks_anew"), F.col("goal_anchor"))
    )
    # Read twice by the ordered pass and again by what follows: the texts are read once, the slim rows kept.
    rows = rows.select(*kept, "project", "chars", "flags", "explicit", "asks_anew", "base_anchor", "goal_anchor", "family_anchor", "head_id", "named")
    keys, order = ["session_key"], ["captured_at", "id"]
    rows = range_blocks(rows.withColumn("first", first).withColumn("own", own), keys, order, blocks)
    rows = previous_value(rows, keys, order, F.col(RANGE), F.col("own"), "before")
    opens = F.col("first") | F.coalesce(F.col("explicit") != F.col("before"), F.lit(False)) | F.col("asks_anew")
    return rows.select(
        *kept, "project", "chars", "flags",
        F.coalesce("own", "before").alias("anchor"), opens.alias("opens"), F.when(opens, F.col("named")).alias("segment_title"), RANGE,
    )


def number_segments(segmented: DataFrame) -> DataFrame:
    """Ordinal of each row's segment within its session."""
    return running_total(
        segmented, ["session_key"], ["captured_at", "id"], F.col(RANGE), F.col("opens").cast("int"), "segment"
    ).drop(RANGE)


# --- topics --------------------------------------------------------------------------------------
def topic_priority(segmented: DataFrame, latest: Column) -> DataFrame:
    """(topic_id, priority): repetition, failure, validation, decision, automated output, and age, all capped."""
    rows = segmented.groupBy("topic_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("date").alias("first_date"),
        *[F.bool_or(F.col("flags")[i]).alias(f"f{i}") for i in range(len(fv.PRIORITY_RULES))],
    )
    points = sum(
        (F.when(F.col(f"f{i}"), weight).otherwise(0) for i, (_, weight) in enumerate(fv.PRIORITY_RULES)),
        F.least(F.lit(8), F.col("n") - 1) + F.least(F.lit(14), F.greatest(F.lit(0), F.datediff(latest, "first_date"))),
    )
    return rows.select("topic_id", points.cast("long").alias("priority"))


def retry_state(
    attempts: DataFrame, now: Column, base_hours: float = fv.RETRY_BACKOFF_HOURS, quiet_hours: float = fv.QUIET_HOURS,
    recent_hours: float = fv.RECENT_HOURS,
) -> DataFrame:
    """Back-off, eligibility and lane over rows with attempt_count, last_attempt_at, last_pending_at, last_seen, settled_before."""
    tried = F.col("attempt_count") > 0
    fresh = F.coalesce(F.col("last_pending_at") > F.col("last_attempt_at"), F.lit(False))
    wait = F.least(F.lit(float(fv.RETRY_BACKOFF_CAP_HOURS)), F.lit(float(base_hours)) * F.pow(F.lit(2.0), F.greatest(F.lit(0), F.col("attempt_count") - 1)))
    retry_after = hours_after(F.col("last_attempt_at"), wait)
    cooling = F.coalesce(tried & ~fresh & (now < retry_after), F.lit(False))
    quiet_until = hours_after(F.coalesce(F.col("last_seen"), now), quiet_hours)
    eligible = (now >= quiet_until) & ~cooling
    state = F.when(eligible, F.when(F.col("settled_before"), "reopened").otherwise("ready")).otherwise("open")
    recent = F.unix_micros(now) - F.unix_micros(F.coalesce(F.col("last_seen"), now)) <= F.lit(int(recent_hours * 3_600_000_000))
    lane = F.when(tried, "retry").when(recent, "recent").otherwise("backlog")
    return attempts.select(
        "*", quiet_until.alias("quiet_until"), retry_after.alias("retry_after"), cooling.alias("retry_cooling"), eligible.alias("eligible"),
        state.alias("eligibility_state"), lane.alias("lane"),
    )


def topic_attempts(topic_events: DataFrame, ledger: DataFrame, ledger_events: DataFrame) -> DataFrame:
    """Per topic: earlier failed or pending attempts (backfills aside), the last one, and whether it was settled before."""
    matches = match_settlements(topic_events, ledger_events, "topic_id")
    told = matches.join(ledger.select(F.col("id").alias("settlement_id"), "status", "updated_at"), "settlement_id")
    attempt = F.col("status").isin("pending", "failed") & ~F.col("settlement_id").startswith("outcome:backfill:")
    return told.groupBy("topic_id").agg(
        F.count_if(attempt).alias("attempt_count"), F.max(F.when(attempt, F.col("updated_at"))).alias("last_attempt_at"),
        F.bool_or(F.col("status").isin("succeeded", "not-applicable")).alias("settled_before"),
        F.count(F.lit(1)).alias("related_settlements"),
    )


def with_topics(segmented: DataFrame) -> DataFrame:
    """Segmented pairs with their topic id.

    Topics, attempts, priorities and the selection all read these slim rows; callers that need more than
    one of them write the rows once (``session.cut_lineage`` or a table) instead of segmenting again.
    """
    return segmented.withColumn("topic_id", t.topic_id(F.col("anchor")))


def build_topics(
    pairs: DataFrame, ledger: DataFrame, ledger_events: DataFrame, now: Column, quiet_hours: float = fv.QUIET_HOURS,
    recent_hours: float = fv.RECENT_HOURS, retry_backoff_hours: float = fv.RETRY_BACKOFF_HOURS,
) -> DataFrame:
    """Topics with a pending pair, from ``with_topics`` rows that carry ``pending``."""
    pending = F.col("pending")
    at = F.struct("captured_at", "id")
    heads = pairs.groupBy("topic_id").agg(
        F.min_by(F.struct("anchor", "source", "project", "segment_title"), at).alias("h"),
        F.count(F.lit(1)).alias("pair_count"), F.count_if(pending).alias("pending_pair_count"), F.count_if(~pending).alias("context_pair_count"),
        F.sum(F.when(pending, F.col("chars")).otherwise(0)).alias("pending_chars"),
        F.sum(F.when(~pending, F.col("chars")).otherwise(0)).alias("context_chars"), F.min("captured_at").alias("first_seen"),
        F.max("captured_at").alias("last_seen"), F.max(F.when(pending, F.col("captured_at"))).alias("last_pending_at"),
        F.max(F.when(pending, F.col("chars"))).alias("largest_pending_pair"),
    )
    events = pairs.select("topic_id", F.explode("source_event_ids").alias("event_id"))
    latest = pairs.agg(F.max("date")).scalar()
    reused = reusable_settlement(events, ledger, ledger_events, "topic_id").withColumnRenamed("settlement_id", "reused_id")
    rows = (
        heads.where(F.col("pending_pair_count") > 0).join(topic_priority(pairs, latest), "topic_id")
        .join(topic_attempts(events, ledger, ledger_events), "topic_id", "left").join(reused, "topic_id", "left")
    )
    rows = rows.select(
        F.coalesce("reused_id", "topic_id").alias("id"), "topic_id", "h.anchor", "h.source", "h.project",
        F.col("h.segment_title.title").alias("title"), F.col("h.segment_title.source").alias("title_source"), "pair_count",
        "pending_pair_count", "context_pair_count", "pending_chars", "context_chars", "first_seen", "last_seen", "last_pending_at",
        "largest_pending_pair", "priority", F.coalesce("attempt_count", F.lit(0)).alias("attempt_count"), "last_attempt_at",
        F.coalesce("settled_before", F.lit(False)).alias("settled_before"), F.coalesce("related_settlements", F.lit(0)).alias("related_settlements"),
    )
    return retry_state(rows, now, retry_backoff_hours, quiet_hours, recent_hours)


def topic_order() -> list[Column]:
    """Unattempted first, then oldest attempt, highest priority, first seen, id."""
    return [F.col("last_attempt_at").asc_nulls_first(), F.col("priority").desc(), F.col("first_seen"), F.col("id")]


def order_topics(topics: DataFrame) -> DataFrame:
    return topics.orderBy(*topic_order())


def round_robin(df: DataFrame, group: str, order: list[Column], within: list[str] | None = None, depth: int | None = None) -> DataFrame:
    """Interleave groups: every group's first row, then every second row, and so on, groups by their first row.

    ``order`` are ascending keys. Adds ``turn``, the place within the group, and ``group_head``, the sort key of the group's first row; sorting by
    (turn, group_head) interleaves. With ``depth`` only the first rows of each group are ranked, before the shuffle as well
    as after it; for groups of any size use ``interleaved``.
    """
    keys = [*(within or []), group]
    key = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)])
    rows = df.withColumn("_key", key)
    ranked = rows.withColumn("turn", F.row_number().over(Window.partitionBy(*keys).orderBy("_key")))
    if depth is not None:
        ranked = ranked.where(F.col("turn") <= depth)
    heads = rows.groupBy(*keys).agg(F.min("_key").alias("group_head"))
    return ranked.join(heads, keys).drop("_key")


def fit_slice(pairs: DataFrame, max_pairs: int, max_chars: int, topic: str = "topic_id") -> DataFrame:
    """Longest prefix of each topic's pending pairs within a pair and a character budget.

    Both limits are monotone along the order, so the prefix is a filter on ranks and running sums; ranks
    beyond the pair budget are dropped before the shuffle.
    """
    order = ["captured_at", "id"]
    head = first_rows(pairs.where(F.col("pending")), [topic], order, max_pairs, rank="place")
    so_far = F.sum("chars").over(Window.partitionBy(topic).orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
    return head.withColumn("chars_so_far", so_far).where(F.col("chars_so_far") <= max_chars)


# --- selection -----------------------------------------------------------------------------------
_SELECTED = "id string, topic_id string, lane string, place int, pairs int, chars long, partial boolean"
_SORT = ["attempt_key", "priority_key", "seen_key", "id"]


def interleaved(rows: DataFrame, within: list[str], group: str, order: list[str], blocks: int | None = None) -> DataFrame:
    """Rows with ``turn``, their place within (``within``, group), and ``group_head``, the first row's order of the group.

    Sorted by (turn, group_head) the groups take turns, each with its next row. Ranks are counted over range blocks, so
    neither a group nor a whole lane has to fit into one task. ``order`` must tell rows apart and hold no nulls.
    """
    keys = [*within, group]
    ranked = running_total(range_blocks(rows, keys, order, blocks), keys, order, F.col(RANGE), F.lit(1), "turn").drop(RANGE)
    heads = rows.groupBy(*keys).agg(F.min(F.struct(*order)).alias("group_head"))
    return ranked.join(heads, keys)


def lane_order(topics: DataFrame, pairs: DataFrame, max_chars: int) -> DataFrame:
    """Eligible topics whose first pending pair is within ``max_chars``, in the order their lanes offer them.

    Topics that are too large keep their turn. Written once; every later reading is a filter and a few first rows.
    """
    first = pairs.where("pending").groupBy("topic_id").agg(F.min_by("chars", F.struct("captured_at", "id")).alias("first_chars"))
    rows = topics.where("eligible").select(
        "lane", "project", "topic_id", "id", "pending_pair_count", F.coalesce(F.unix_micros("last_attempt_at"), F.lit(-(2**62))).alias("attempt_key"),
        (-F.col("priority")).alias("priority_key"), F.unix_micros("first_seen").alias("seen_key"),
    )
    ranked = interleaved(rows, ["lane"], "project", _SORT).join(first, "topic_id").where(F.col("first_chars") <= max_chars)
    return cut_lineage(ranked.select("lane", "turn", "group_head", "id", "topic_id", "pending_pair_count", "first_chars"), "lane-order")


def _further(ranked: DataFrame, pairs: DataFrame, lane: str, after, room: int, count: int, max_pairs: int) -> list:
    """The next ``count`` topics of a lane whose first pair has room, with the sizes of their first ``max_pairs`` pairs."""
    rows = ranked.where((F.col("lane") == lane) & (F.col("first_chars") <= room))
    if after is not None:
        head = F.struct(*[F.lit(after.group_head[c]).alias(c) for c in _SORT])
        rows = rows.where((F.col("turn") > after.turn) | ((F.col("turn") == after.turn) & (F.col("group_head") > head)))
    rows = rows.orderBy("turn", "group_head").limit(count)
    wanted = pairs.where("pending").join(rows.select("topic_id"), "topic_id", "left_semi")
    sizes = first_rows(wanted, ["topic_id"], ["captured_at", "id"], max_pairs, rank="n").groupBy("topic_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("n", "chars"))), lambda x: x["chars"]).alias("sizes")
    )
    return rows.join(sizes, "topic_id").orderBy("turn", "group_head").collect()


def select_topics(
    topics: DataFrame, pairs: DataFrame, max_topics: int = fv.SELECTION_TOPICS, max_pairs: int = fv.SELECTION_PAIRS,
    max_chars: int = fv.SELECTION_CHARS, lane_offset: int = 0,
) -> DataFrame:
    """Fair bounded selection of eligible topics: (id, topic_id, lane, place, pairs, chars, partial).

    Lanes rotate by batch, projects take turns within a lane, each lane has its share of the budget, and a topic may
    enter in part. The order of the lanes is worked out once and written. The greedy fit asks it, lane by lane, for the
    next few topics that the room left can take; room only shrinks, so a topic passed over never has to be offered again,
    and a lane that runs out is asked for what follows. What is held at a time is ``max_topics`` topics of three lanes with
    at most ``max_pairs`` sizes each.
    """
    max_topics, max_pairs, max_chars = max(0, max_topics), max(1, max_pairs), max(1, max_chars)
    spark = topics.sparkSession
    lanes = {r.lane for r in topics.where("eligible").select("lane").distinct().collect()}
    share = max(1, min(max_topics, len(lanes)))
    pair_cap, char_cap = max(1, max_pairs // share), max(1, max_chars // share)
    ranked = lane_order(topics, pairs, char_cap)
    waiting: dict[str, list] = {lane: [] for lane in LANES}
    last, ended = dict.fromkeys(LANES), {lane for lane in LANES if lane not in lanes}
    taken: list[tuple] = []
    used_pairs = used_chars = 0

    def next_fit(lane: str):
        nonlocal used_pairs, used_chars
        while True:
            room_pairs, room_chars = min(max_pairs - used_pairs, pair_cap), min(max_chars - used_chars, char_cap)
            if room_pairs < 1 or room_chars < 0:
                return None
            while waiting[lane]:
                topic = waiting[lane].pop(0)
                count = chars = 0
                for length in topic.sizes[:room_pairs]:
                    if chars + length > room_chars:
                        break
                    count, chars = count + 1, chars + length
                if count:
                    return topic, count, chars
            if lane in ended:
                return None
            waiting[lane] = _further(ranked, pairs, lane, last[lane], room_chars, max_topics, max_pairs)
            if len(waiting[lane]) < max_topics:
                ended.add(lane)
            if waiting[lane]:
                last[lane] = waiting[lane][-1]

    start = lane_offset % len(LANES)
    moved = max_topics > 0
    while moved and len(taken) < max_topics:
        moved = False
        for lane in LANES[start:] + LANES[:start]:
            if len(taken) < max_topics and (fit := next_fit(lane)) is not None:
                topic, count, chars = fit
                used_pairs, used_chars, moved = used_pairs + count, used_chars + chars, True
                taken.append((topic.id, topic.topic_id, lane, len(taken) + 1, count, chars, count < topic.pending_pair_count))
    return spark.createDataFrame(taken, _SELECTED)


def queue_status(
    sorted_pairs: DataFrame, topics: DataFrame, selection: DataFrame, max_pairs: int = fv.SELECTION_PAIRS, max_chars: int = fv.SELECTION_CHARS
) -> DataFrame:
    """Counters of the queue as (counter, value) rows: one aggregate per input, stacked."""
    cls = lambda name: F.count_if(F.col("pending") & (F.col("queue_class") == name))
    lane = lambda name: F.count_if(F.col("lane") == name)
    by_pairs = sorted_pairs.agg(
        F.count_if("pending").alias("raw_pending_pairs"), cls("no-op").alias("no_op_automation_pairs"),
        cls("substantive").alias("substantive_automation_pairs"), cls("supporting").alias("supporting_pairs"),
        (cls("candidate") + cls("substantive")).alias("candidate_pairs"),
    )
    whole = selection.where(~F.col("partial")).select("topic_id")
    by_topics = topics.agg(
        F.count(F.lit(1)).alias("candidate_topics"), F.count_if("eligible").alias("ready_topics"),
        F.count_if((F.col("eligibility_state") == "open") & ~F.col("retry_cooling")).alias("open_topics"), lane("retry").alias("retry_topics"),
        F.count_if("retry_cooling").alias("cooling_retry_topics"), lane("backlog").alias("backlog_topics"), lane("recent").alias("recent_topics"),
        F.count_if(F.col("eligible") & ((F.col("pending_pair_count") > max_pairs) | (F.col("pending_chars") > max_chars))).alias("deferred_oversize_topics"),
        F.count_if(F.col("eligible") & (F.col("largest_pending_pair") > max_chars)).alias("needs_compaction_topics"),
    )
    by_choice = selection.agg(
        F.count(F.lit(1)).alias("selected_topics"), F.coalesce(F.sum("pairs"), F.lit(0)).alias("selected_pairs"),
        F.coalesce(F.sum("chars"), F.lit(0)).alias("selected_chars"), F.count_if("partial").alias("partial_topics"),
    )
    deferred = topics.join(whole, "topic_id", "left_anti").agg(F.count(F.lit(1)).alias("deferred_topics"))
    out = None
    for part in (by_pairs, by_topics, by_choice, deferred):
        long = part.select(F.explode(F.map_from_arrays(
            F.array(*[F.lit(c) for c in part.columns]), F.array(*[F.col(c).cast("long") for c in part.columns])
        )).alias("counter", "value"))
        out = long if out is None else out.unionByName(long)
    return out


def bounded_recent(
    df: DataFrame, order: list[str], size: Column, count: int = fv.QUEUE_EVENTS, chars: int = fv.QUEUE_CHARS, owner: list[str] | None = None
) -> DataFrame:
    """Newest rows of each queue within a count and a cumulative size; the first that does not fit ends it."""
    keys = owner or []
    newest = [F.col(c).desc() for c in order]
    sized = df.withColumn("_size", size)
    if keys:
        head = first_rows(sized, keys, newest, count, rank="_n")
    else:
        head = sized.orderBy(*newest).limit(count)
    total = F.sum("_size").over(Window.partitionBy(*keys).orderBy(*newest).rowsBetween(Window.unboundedPreceding, 0))
    return head.withColumn("_total", total).where(F.col("_total") <= chars).drop("_total", "_size", "_n")


def canonical_project(topics: DataFrame, folders: DataFrame) -> DataFrame:
    """Existing folder that equals a project up to case, else a cleaned name."""
    from tracefold.functions.projects import directory_name

    asked = F.lower(F.coalesce(blank_to_null(F.trim("project")), F.lit(fv.UNASSIGNED)))
    known = folders.where(F.col("folder") != fv.EXPERIENCE_FOLDER).groupBy(F.lower("folder").alias("_key")).agg(F.min("folder").alias("_folder"))
    joined = topics.withColumn("_key", asked).join(known, "_key", "left")
    return joined.withColumn("project_directory", F.coalesce("_folder", directory_name(F.col("project")))).drop("_key", "_folder")
