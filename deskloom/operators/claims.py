"""Unique values that change hands in a batch: who gets which, as a row-by-row table would decide.

An edit asks for a value and is refused while another key holds it; a key gives its value up with
the next accepted edit that asks for something else. Values that concern one key only are never
refused, so only the others stay in play. Their asks are judged in rounds: from a guess of which
edits are accepted, each ask gets the time at which its key would leave the value again, and one
pass over each value's asks in order gives the next guess. What is judged before some time depends
on earlier edits only, so every round settles at least one more edit, and a guess that repeats
itself is the outcome. In practice the rounds are as many as the longest chain of values that wait
for each other, not as many as the edits of a hot value: a pass settles a whole value. After the
first rounds few verdicts still change, and only what hangs on them is judged again. Rounds carry
numbers only: the key, the value's number and the time.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from deskloom.functions.text import folded
from deskloom.operators.numbering import with_sequence
from deskloom.session import pin, scratch, ship

#: Rounds over all events, before those that look at what has changed.
ROUNDS = 2
_START = -1


def _contested(asks: DataFrame, own: DataFrame, key: str, value: str) -> DataFrame:
    """``value, _name`` of all spellings of values that more than one key has or asks for; names are numbers.

    Spellings are counted as they are first, so the collated grouping sees each once.
    """
    claims = asks.select(key, value).unionByName(own).where(F.col(value).isNotNull())
    spelled = claims.groupBy(value).agg(F.min(key).alias("_low"), F.max(key).alias("_high"))
    same = Window.partitionBy(folded(F.col(value)))
    ranged = spelled.select(
        value, F.min(value).over(same).alias("_least"), F.min("_low").over(same).alias("_low"), F.max("_high").over(same).alias("_high")
    )
    contested = pin(ranged.where("_low < _high").select(value, "_least"), "contested-values")
    names = pin(contested.select("_least").distinct().withColumn("_name", F.monotonically_increasing_id()), "contested-names")
    return contested.join(names, "_least").select(value, "_name")


def _named(rows: DataFrame, names: DataFrame, value: str) -> DataFrame:
    """``rows`` with the name of their value. Rows without a value do not travel to one task."""
    given = rows.where(F.col(value).isNotNull()).join(names, value, "left")
    return given.unionByName(rows.where(F.col(value).isNull()).withColumn("_name", F.lit(None).cast("bigint")))


def _events(asks: DataFrame, own: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """What happens to contested values: starts, asks, and edits that may give one up: ``key, _name, _row, _at``.

    ``_at`` tells events apart; below zero are the starts. An event that asks for no contested value
    has no ``_name``; of several in a row only the first gives something up. Asks are shuffled once by
    value, once by key and once by time, and written in between, so that one shuffle lies on the disks at a time.
    """
    in_order = [F.desc("_own"), *[F.asc(c) for c in (*order, key, "_turn")]]
    with scratch(asks.sparkSession, keep=1):
        names = pin(_contested(asks, own, key, value), "contested")
        wanted = _named(asks, names, value).withColumn("_own", F.lit(False))
        held = _named(own, names, value).withColumn("_own", F.lit(True))
        rows = wanted.unionByName(held, allowMissingColumns=True).where(F.col(key).isNotNull())
        with scratch(asks.sparkSession, keep=1):
            played = pin(_played(pin(rows, "named-claims", compression="zstd"), key, order, value), "played-claims", compression="zstd")
        ranged = played.repartitionByRange(*in_order).sortWithinPartitions(*in_order)
        slots = pin(ranged.select(key, "_name", "_row", "_own", F.monotonically_increasing_id().alias("_slot")), "claims")
    return with_sequence(slots, [], "_at").withColumn("_at", F.when(F.col("_own"), -F.col("_at")).otherwise(F.col("_at"))).drop("_own")


def _played(rows: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """The rows of keys that the table has and that have or ask for a contested value, but for those that change nothing;
    ``_turn`` is their place among the rows of their key."""
    alike = Window.partitionBy(key)
    turns = alike.orderBy(F.desc("_own"), *order, value)
    earlier = F.lag(F.when(~F.col("_own"), F.struct("_name"))).over(turns)
    known, plays = F.max("_own").over(alike), F.max(F.col("_name").isNotNull()).over(alike)
    rows = rows.withColumns({"_known": known, "_plays": plays, "_turn": F.row_number().over(turns), "_earlier": earlier})
    idle = F.col("_name").isNull() & (F.col("_own") | F.coalesce(F.col("_earlier").isNotNull() & F.col("_earlier._name").isNull(), F.lit(False)))
    return rows.where(F.col("_known") & F.col("_plays") & ~idle).select(key, *order, "_name", "_row", "_own", "_turn")


def _leaves(events: DataFrame, key: str) -> DataFrame:
    """Events with ``_same`` (the key has the value already) and ``_until`` (when it would leave it)."""
    over = f"ignore nulls over (partition by `{key}` order by _at)"
    df = events.withColumn("_taken", F.expr("if(_accepted, struct(_name), null)"))
    df = df.withColumn("_has", F.expr(f"lag(_taken) {over}"))
    df = df.withColumn("_same", F.expr("coalesce(_has._name = _name, false)"))
    df = df.withColumn("_move", F.expr("if(_accepted and not (_has is not null and _has._name <=> _name), _at, null)"))
    df = df.withColumn("_moved", F.expr(f"lead(_move) {over}"))
    df = df.withColumn("_taken", F.expr("if(_accepted, struct(_name, _at, _moved), null)"))
    df = df.withColumn("_next", F.expr(f"lead(_taken) {over}"))
    df = df.withColumn("_until", F.expr("if(_next._name <=> _name, _next._moved, _next._at)"))
    return df.drop("_taken", "_has", "_move", "_moved", "_next")


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One pass over rows in order of value and time; only the current holder's end is kept."""
    current, end = None, 0
    forever = 1 << 62
    for batch in batches:
        accepted = []
        columns = [batch.column(c) for c in ("_name", "_at", "_same", "_until")]
        columns[3] = columns[3].fill_null(forever)
        for name, at, same, until in zip(*(c.to_numpy(zero_copy_only=False).tolist() for c in columns)):
            if name != current:
                current, end = name, _START
            if at < 0:
                end = max(end, until)  # keys that share a value from the start all have to leave it
                accepted.append(True)
            elif same:
                accepted.append(True)
            elif end <= at:
                end = until
                accepted.append(True)
            else:
                accepted.append(False)
        names = batch.schema.names
        judged = pa.array(accepted, pa.bool_())
        yield pa.RecordBatch.from_arrays([judged if c == "_judged" else batch.column(c) for c in names], names)


def _verdicts(named: DataFrame) -> DataFrame:
    """Events with ``_judged`` anew, from their ``_same`` and ``_until``."""
    in_order = named.repartition("_name").sortWithinPartitions("_name", "_at")
    return in_order.mapInArrow(_judge, in_order.schema)


def _laid_over(events: DataFrame, changes: DataFrame | None) -> DataFrame:
    """Events with the columns that ``changes`` has for some of them."""
    if changes is None:
        return events
    columns = [c for c in changes.columns if c != "_at"]
    told = changes.select("_at", F.struct(*columns).alias("_new"))
    new = F.col("_new").isNotNull()
    joined = events.join(told, "_at", "left")
    return joined.select(*[F.when(new, F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in events.columns])


def _settled(events: DataFrame, key: str) -> DataFrame:
    """``_at`` of the refused events.

    The first rounds judge all events. Each later one looks again at the keys of changed verdicts
    only, and at the values for which one of their times has changed: all others would be judged
    as before. What has changed since the first rounds is kept beside them.
    """
    judged = events.select(key, "_name", "_at", F.lit(True).alias("_judged"))
    for _ in range(ROUNDS):
        played = _leaves(judged.select(key, "_name", "_at", "_judged", F.col("_judged").alias("_accepted")), key)
        judged = _verdicts(played.where(F.col("_name").isNotNull())).unionByName(played.where(F.col("_name").isNull()))
    judged = pin(judged, "claims-judged")
    changed, changes = judged.where("_judged <> _accepted"), None
    state = judged.drop("_accepted")
    while not changed.isEmpty():
        keys = pin(changed.select(key).distinct(), "claims-keys")
        again = _laid_over(state.join(keys, key, "left_semi"), changes)
        before = again.withColumn("_was", F.struct("_same", "_until")).drop("_same", "_until").withColumn("_accepted", F.col("_judged"))
        moved = _leaves(before, key).where(F.col("_name").isNotNull() & ~F.col("_was").eqNullSafe(F.struct("_same", "_until")))
        times = pin(moved.select("_at", "_name", "_same", "_until"), "claims-times")
        names = pin(times.select("_name").distinct(), "claims-names")
        touched = _laid_over(state.join(names, "_name", "left_semi"), changes).withColumns({"_fresh": F.lit(False), "_accepted": F.col("_judged")})
        touched = _laid_over(touched, times.drop("_name").withColumn("_fresh", F.lit(True)))
        verdicts = _verdicts(touched).where("_fresh or _judged <> _accepted")
        new = pin(verdicts.select("_at", key, "_judged", "_same", "_until", "_accepted"), "claims-changed")
        changed = new.where("_judged <> _accepted")
        fresh = new.select("_at", "_judged", "_same", "_until")
        changes = fresh if changes is None else pin(changes.join(fresh, "_at", "left_anti").unionByName(fresh), "claims-changes")
    return _laid_over(state, changes).where(~F.col("_judged")).select("_at")


def refused_rows(asks: DataFrame, own: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """``_row`` of the asks (``key, *order, value, _row``) that a table with a unique ``value`` would refuse.

    ``own`` has every key of the table with its value before the batch. Edits take effect in order,
    those of one time by key. An ask without a value gives the key's value up; one for the value the
    key has changes nothing. Keys that the table does not have ask in vain and are not reported.
    Case and accents do not tell two values apart. ``asks`` is read several times: give a written
    table.
    """
    ship(asks.sparkSession)
    events = _events(asks.select(key, *order, value, "_row"), own.select(key, value), key, order, value)
    return events.select("_at", "_row").join(_settled(events, key), "_at", "left_semi").select("_row")


def refused(asks: DataFrame, own: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """The refused asks themselves, ``key, *order, value``; see ``refused_rows``."""
    asks = pin(asks.select(key, *order, value).withColumn("_row", F.monotonically_increasing_id()), "asks")
    return asks.join(refused_rows(asks, own, key, order, value), "_row", "left_semi").drop("_row")
