"""Consumer groups: committed offsets, membership, and the checks of heartbeats and syncs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Protocol error codes.
NONE, UNKNOWN_GROUP, WRONG_GENERATION, UNKNOWN_MEMBER, MEMBER_ID_REQUIRED = 0, 16, 22, 25, 79
KEY = ["grp", "topic", "part"]


def commits(rec: DataFrame) -> DataFrame:
    """The synthetic commits: every fifth event, group user_id % 3, the next offset."""
    r = rec.where(F.col("event_id") % 5 == 0)
    return r.select(F.col("event_id").alias("seq"), (F.col("user_id") % 3).cast("int").alias("grp"), "topic", "part", (F.col("off") + 1).alias("committed"))


def latest_offsets(log: DataFrame) -> DataFrame:
    """Last write wins per key; a latest null is a deletion."""
    m = log.groupBy(*KEY).agg(F.max(F.struct("seq", "committed")).alias("m"))
    return m.select(*KEY, F.col("m.committed").alias("committed")).where("committed IS NOT NULL")


def latest_commits(log: DataFrame, value: list[str]) -> DataFrame:
    """As ``latest_offsets``, for stores that keep more than the offset (leader epoch, metadata)."""
    m = log.groupBy(*KEY).agg(F.max(F.struct("seq", *value)).alias("m"))
    return m.select(*KEY, *[F.col(f"m.{v}").alias(v) for v in value])


def fetch_response(latest: DataFrame) -> DataFrame:
    """What an offset fetch answers: this store keeps neither leader epochs nor times."""
    return latest.withColumns({"leader_epoch": F.lit(-1), "timestamp": F.lit(0).cast("long")})


def delete_group(latest: DataFrame, grp: int) -> DataFrame:
    return latest.where(F.col("grp") != grp)


def delete_offset(latest: DataFrame, grp: int, topic: str, part: int) -> DataFrame:
    return latest.where(~((F.col("grp") == grp) & (F.col("topic") == topic) & (F.col("part") == part)))


def member_events(events: DataFrame) -> DataFrame:
    """The synthetic membership log: group = topic, member = user."""
    kind = F.when(F.col("event_id") % 3 == 0, "leave").otherwise("join")
    return events.select(F.col("event_id").alias("seq"), F.col("event_type").alias("grp"), F.col("user_id").alias("member"), kind.alias("kind"))


def effective(log: DataFrame) -> DataFrame:
    """Events that change membership: a join of a non-member, a leave of a member."""
    prev = F.coalesce(F.lag("kind").over(Window.partitionBy("grp", "member").orderBy("seq")), F.lit("leave"))
    return log.withColumn("prev", prev).where("kind <> prev").drop("prev")


def group_state(log: DataFrame) -> DataFrame:
    """generation, members, leader of each group. Re-joins and leaves of non-members do not count;
    the leader is the smallest member; an empty group keeps its generation."""
    eff = effective(log)
    generation = eff.groupBy("grp").agg(F.count("*").alias("generation"))
    last = log.groupBy("grp", "member").agg(F.max(F.struct("seq", "kind")).alias("m")).where("m.kind = 'join'")
    now = last.groupBy("grp").agg(F.count("*").alias("members"), F.min("member").alias("leader"))
    every = log.select("grp").distinct()
    out = every.join(generation, "grp", "left").join(now, "grp", "left")
    return out.select("grp", F.coalesce("generation", F.lit(0)).alias("generation"), F.coalesce("members", F.lit(0)).alias("members"), "leader")


def list_groups(state: DataFrame) -> DataFrame:
    return state.select("grp", F.when(F.col("members") > 0, "Stable").otherwise("Empty").alias("state"))


def members(log: DataFrame) -> DataFrame:
    last = log.groupBy("grp", "member").agg(F.max(F.struct("seq", "kind")).alias("m"))
    return last.where("m.kind = 'join'").select("grp", "member")


def _code(known: Column, generation: Column, asked: Column, member: Column) -> Column:
    return F.when(~known, UNKNOWN_GROUP).when(asked != generation, WRONG_GENERATION).when(~member, UNKNOWN_MEMBER).otherwise(NONE).cast("int")


def heartbeat(requests: DataFrame, log: DataFrame) -> DataFrame:
    """requests (grp, member, generation) -> code: unknown group, generation, member, in this order."""
    state = group_state(log).select("grp", F.col("generation").alias("now"))
    present = members(log).withColumn("present", F.lit(True))
    r = requests.join(state, "grp", "left").join(present, ["grp", "member"], "left")
    code = _code(F.col("now").isNotNull(), F.coalesce("now", F.lit(-1)), F.col("generation"), F.coalesce("present", F.lit(False)))
    return r.select("grp", "member", "generation", code.alias("code"))


def sync(requests: DataFrame, log: DataFrame, assignments: DataFrame) -> DataFrame:
    """As heartbeat, with the leader's assignment (grp, member, assignment) where the code is 0."""
    h = heartbeat(requests, log).join(assignments, ["grp", "member"], "left")
    return h.withColumn("assignment", F.when(F.col("code") == NONE, F.col("assignment")))


def join_code(member: Column) -> Column:
    """An empty member id is answered with a minted one first."""
    return F.when(F.coalesce(member, F.lit("")) == "", MEMBER_ID_REQUIRED).otherwise(NONE).cast("int")


def counted_joins(log: DataFrame) -> DataFrame:
    """The in-memory stub's rule: every join counts, also of a member; the first to join an empty group leads while it is one.

    A leave of a member counts too; a leader that leaves is followed by the smallest member left. Here: generation and members.
    """
    prev = F.coalesce(F.lag("kind").over(Window.partitionBy("grp", "member").orderBy("seq")), F.lit("leave"))
    d = log.withColumn("prev", prev)
    bumps = d.where("kind = 'join' OR prev = 'join'").groupBy("grp").agg(F.count("*").alias("generation"), F.min(F.when(F.col("kind") == "join", F.struct("seq", "member"))).alias("m"))
    now = members(log).groupBy("grp").agg(F.count("*").alias("members"))
    out = log.select("grp").distinct().join(bumps, "grp", "left").join(now, "grp", "left")
    return out.select("grp", F.coalesce("generation", F.lit(0)).alias("generation"), F.coalesce("members", F.lit(0)).alias("members"), F.col("m.member").alias("first_member"))


def range_assignment(log: DataFrame, partitions: int) -> DataFrame:
    """A plain client-side rule: partition p of n members goes to member p mod n in id order."""
    rank = (F.row_number().over(Window.partitionBy("grp").orderBy("member")) - 1).alias("rank")
    m = members(log).select("grp", "member", rank)
    n = m.groupBy("grp").agg(F.count("*").alias("n"))
    parts = n.select("grp", "n", F.explode(F.sequence(F.lit(0), F.lit(partitions - 1))).alias("part"))
    return parts.withColumn("rank", F.col("part") % F.col("n")).join(m, ["grp", "rank"]).select("grp", "part", "member")
