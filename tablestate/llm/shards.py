"""Shards of equal counts that keep linked documents together: balanced label propagation.

Documents that share a link value (equal texts, unless the caller says otherwise) are linked. A shard is a label.
Linked documents start with labels dealt over all shards; in each round every link value counts its documents by
label, chooses the fewest shards that can hold them, those that already have most first, and its documents elsewhere
ask to move there. A round's moves keep to quotas: from shard to shard as many go as come, beyond that only into a
shard's free room, moves that unite most links first. So no shard ever holds more than its share, and the links cut
only become fewer; rounds end when all links are whole or no move unites more. Last, documents without links, which cut nothing wherever
they are, fill the shards up to their exact counts, dealt evenly by size.

Links never become pairs: a link value is a hub, and its documents' votes are counts by (value, shard), combined
before they are shuffled. Values with more than an eighth of a shard's documents, of which there are at most eight for
each shard, go first, as a short table sent to every task; so the documents of one value meet in a task only where
they are under an eighth of a shard. Votes, moves and quotas are counts by shard or pair of shards.

Lineage ends with each round, in tables of row numbers, links and labels; texts are read once.

Defined results: a null text is an empty one, and empty texts are equal. Null and repeated ids are rows like others;
repeated rows are equal texts. Fewer documents than shards leave shards empty. Columns other than doc_id and text are
not looked at. An empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import keep, prepare, remove

SHARDS = 40
#: What a document takes beside its text.
ROW_BYTES = 16
#: A link value with more than this share of a shard's documents goes before the others.
LARGE = 8
#: Rows that would move alike are taken in so many portions by a hash of their numbers.
PORTIONS = 64


def numbered(df: DataFrame, column: str, name: str) -> DataFrame:
    """df in a table of its own, with gapless numbers from 0 in the order of its partitions and rows."""
    kept = keep(df.withColumn("mono_", F.monotonically_increasing_id()), name)
    part = F.shiftright("mono_", 33)
    ends = kept.groupBy(part.alias("part_")).agg(F.count(F.lit(1)).alias("rows_"))
    before = Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    starts = ends.select("part_", F.coalesce(F.sum("rows_").over(before), F.lit(0)).alias("start_"))
    out = kept.join(F.broadcast(starts), part == F.col("part_")).withColumn(column, F.col("start_") + F.col("mono_").bitwiseAND(F.lit((1 << 33) - 1)))
    out = out.drop("mono_", "part_", "start_", "rows_")
    out.kept_in = kept.kept_in
    return out


def _long_array(values: list[int]) -> Column:
    return F.expr(f"array({', '.join(f'{v}L' for v in values)})")


def dealt(number: Column, rows: int, rooms: list[int]) -> Column:
    """The shard of row `number` of so many rows: neighbours go to different shards, each gets its part of the rooms.

    Rows are stepped through by a stride near the golden section of their count and prime to it, which spreads any
    stretch of neighbours evenly; the places reached are cut in proportion to the rooms. No shard gets more than its room.
    """
    stride = max(1, round(rows * 0.6180339887498949))
    while math.gcd(stride, rows) != 1:
        stride += 1
    place = F.pmod(number.cast("decimal(19,0)") * F.lit(stride).cast("decimal(19,0)"), F.lit(rows).cast("decimal(38,0)")).cast("long")
    total, upto, ends = sum(rooms), 0, []
    for room in rooms:
        upto += room
        ends.append(rows * upto // total)
    return F.size(F.filter(_long_array(ends), lambda end: end <= place))


def _rooms(capacity: list[int], labels: DataFrame) -> list[int]:
    loads = {r.shard: r.n for r in labels.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each shard
    return [c - loads.get(s, 0) for s, c in enumerate(capacity)]


def _choices(votes: DataFrame, rooms: Column, capacity: Column | None, salt: int) -> DataFrame:
    """(link, plan): for links with documents in shards that they do not choose, an entry for each of their shards.

    Of the shards that hold some of a link's documents those are chosen that could hold most, until they hold all; the
    documents elsewhere are dealt to them by what each still takes. A shard could hold what it has room for; if a
    capacity is given, as much as that, since exchanges make room. A link has at most one vote for each shard.
    """
    of_link = Window.partitionBy("link")
    ranked = of_link.orderBy(F.desc("has_room"), F.desc("n"), F.xxhash64("link", "shard", F.lit(salt)))
    earlier, upto = ranked.rowsBetween(Window.unboundedPreceding, -1), ranked.rowsBetween(Window.unboundedPreceding, 0)
    out = votes.withColumn("size", F.sum("n").over(of_link)).withColumn("has_room", F.least(F.col("n") + rooms[F.col("shard")], F.col("size")))
    out = out.withColumn("could", F.col("has_room") if capacity is None else F.least(capacity[F.col("shard")], F.col("size")))
    out = out.withColumn("left", F.greatest(F.col("size") - F.coalesce(F.sum("could").over(earlier), F.lit(0)), F.lit(0)))
    out = out.withColumn("chosen", F.col("left") > 0).withColumn("takes", F.greatest(F.least("could", "left") - F.col("n"), F.lit(0)))
    takes = F.greatest(F.sum("takes").over(of_link), F.lit(1))
    out = out.withColumn("share_to", F.sum("takes").over(upto) / takes).withColumn("share_from", (F.sum("takes").over(upto) - F.col("takes")) / takes)
    entry = F.struct("shard", "n", "chosen", "takes", "share_from", "share_to")
    return out.groupBy("link").agg(F.collect_list(entry).alias("plan")).where("exists(plan, p -> NOT p.chosen) AND exists(plan, p -> p.takes > 0)")


def _wishes(labels: DataFrame, plan: DataFrame, salt: int) -> DataFrame:
    """(row, shard, wish, level): rows in shards their link did not choose, where they ask to go, and log2 of the gain."""
    draw = F.pmod(F.xxhash64("row", F.lit(salt)), F.lit(1 << 30)) / float(1 << 30)
    joined = labels.select("row", "link", "shard").join(plan, "link").withColumn("draw", draw)
    own = F.expr("get(filter(plan, p -> p.shard = shard), 0)")
    there = F.expr("get(filter(plan, p -> p.takes > 0 AND p.share_from <= draw AND draw < p.share_to), 0)")
    out = joined.select("row", "shard", own.alias("own"), there.alias("there")).where("NOT own.chosen AND there IS NOT NULL")
    gain = F.greatest(F.col("there.n") - F.col("own.n") + 1, F.lit(1))
    return out.select("row", "shard", F.col("there.shard").alias("wish"), F.floor(F.log2(gain)).cast("int").alias("level"))


def _granted(wishes: DataFrame, rooms: Column, salt: int) -> DataFrame:
    """(row, wish) of the wishes that the quotas allow: as many from shard to shard as come back, and then into free room.

    Quotas are by pair of shards. A row's rank in its pair, by gain, is its rank in a portion of the pair's rows and
    the count of the portions before, so no task sorts all rows of a pair.
    """
    graded = wishes.withColumn("portion", F.pmod(F.xxhash64(F.lit(salt), "row"), F.lit(PORTIONS)).cast("int"))
    group = ["shard", "wish", "level", "portion"]
    counts = graded.groupBy(*group).agg(F.count(F.lit(1)).alias("n"))
    pair = counts.groupBy("shard", "wish").agg(F.sum("n").alias("all"))
    back = pair.select(F.col("shard").alias("wish"), F.col("wish").alias("shard"), F.col("all").alias("back"))
    both = pair.join(F.broadcast(back), ["shard", "wish"], "left").withColumn("swap", F.least(F.col("all"), F.coalesce("back", F.lit(0))))
    into = Window.partitionBy("wish").orderBy(F.desc("more"), "shard").rowsBetween(Window.unboundedPreceding, -1)
    more = both.withColumn("more", F.col("all") - F.col("swap")).withColumn("taken", F.coalesce(F.sum("more").over(into), F.lit(0)))
    quota = more.select("shard", "wish", (F.col("swap") + F.greatest(F.least("more", rooms[F.col("wish")] - F.col("taken")), F.lit(0))).alias("quota"))
    earlier = Window.partitionBy("shard", "wish").orderBy(F.desc("level"), "portion").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).join(F.broadcast(quota), ["shard", "wish"]).where("before < quota")
    ranked = graded.join(F.broadcast(starts), group).withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy("row")) + F.col("before"))
    return ranked.where("rank <= quota").select("row", "wish")


def _united(counts: DataFrame) -> int:
    """Pairs of linked documents that are together, from counts n."""
    return counts.agg(F.sum(F.col("n").cast("decimal(38,0)") * F.col("n"))).first()[0] or 0


def propagate(labels: DataFrame, capacity: list[int], large: bool) -> DataFrame:
    """labels (row, link, shard, further columns) after rounds of moves under quotas.

    Rounds plan by the room there is and by what exchanges could make, in turn; they end when all links are whole, or
    one round of each kind in turn unites nothing.
    """
    spark = labels.sparkSession
    votes = labels.groupBy("link", "shard").agg(F.count(F.lit(1)).alias("n"))
    most, united = _united(labels.groupBy("link").agg(F.count(F.lit(1)).alias("n"))), _united(votes)
    turn, idle = 0, 0
    while united < most and idle < 2:
        rooms = _long_array(_rooms(capacity, labels))
        plan = _choices(votes, rooms, _long_array(capacity) if turn % 2 else None, turn)
        wishes = keep(_wishes(labels, F.broadcast(plan) if large else plan, turn), "shard-wishes")
        moved = None
        if not wishes.isEmpty():
            moves = _granted(wishes, rooms, turn)
            moved = keep(labels.join(moves, "row", "left").withColumn("shard", F.coalesce("wish", "shard")).drop("wish").select(labels.columns), "shard-labels")
            new_votes = moved.groupBy("link", "shard").agg(F.count(F.lit(1)).alias("n"))
            now = _united(new_votes)
        remove(spark, wishes)
        turn += 1
        if moved is None or now <= united:
            idle += 1
            if moved is not None:
                remove(spark, moved)
        else:
            idle = 0
            remove(spark, labels)
            labels, votes, united = moved, new_votes, now
    return labels


def _labelled(rows: DataFrame, capacity: list[int], name: str, large: bool) -> DataFrame:
    """Rows with shards: dealt over the room first, then propagated."""
    some = numbered(rows, "number", name)
    n = some.count()
    first = keep(some.withColumn("shard", dealt(F.col("number"), n, capacity)).drop("number"), f"{name}-first") if n else some.withColumn("shard", F.lit(0)).drop("number")
    if n:
        remove(rows.sparkSession, some)
        return propagate(first, capacity, large)
    return first


def with_slots(placed: DataFrame) -> DataFrame:
    """placed (with a column shard) and slot: gapless from 0 in every shard, in the order of files and rows."""
    kept = keep(placed.withColumn("mono_", F.monotonically_increasing_id()), "shard-placed").withColumn("part_", F.shiftright("mono_", 33))
    counts = kept.groupBy("part_", "shard").agg(F.count(F.lit(1)).alias("n_"))
    before = Window.partitionBy("shard").orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    starts = counts.select("part_", "shard", F.coalesce(F.sum("n_").over(before), F.lit(0)).alias("start_"))
    rank = F.row_number().over(Window.partitionBy("part_", "shard").orderBy("mono_"))
    return kept.withColumn("rank_", rank).join(starts, ["part_", "shard"]).withColumn("slot", F.col("start_") + F.col("rank_") - 1).drop("mono_", "part_", "start_", "rank_")


def balanced_shards(docs: DataFrame, shards: int = SHARDS, link: Column | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of all documents; counts of shards are at most one apart.

    link: what linked documents share, equal texts if not given; null links nothing.
    """
    spark = prepare(docs.sparkSession)
    text = F.coalesce("text", F.lit("")).cast("binary")
    value = F.sha2(text, 256) if link is None else F.sha2(link.cast("string").cast("binary"), 256)
    base = keep(
        docs.select(
            F.monotonically_increasing_id().alias("row"),
            "doc_id",
            (F.octet_length(text) + F.lit(ROW_BYTES)).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"),
            F.unhex(value).alias("link"),
        ),
        "shard-documents",
    )
    n = base.count()
    capacity = [n // shards + (s < n % shards) for s in range(shards)]
    many = base.where("link IS NOT NULL").groupBy("link").agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) & (F.col("n") * LARGE > n // shards)).select("link", F.lit(True).alias("large"))
    marked = base.join(F.broadcast(many), "link", "left")
    of_link = F.count("link").over(Window.partitionBy("link", F.when(F.col("link").isNull(), F.col("row"))))
    rest = marked.where("large IS NULL").withColumn("copies", of_link).withColumn("kind", F.when(F.col("copies") > 1, 1).otherwise(2)).drop("copies")
    kinds = keep(marked.where("large").withColumn("kind", F.lit(0)).unionByName(rest).drop("large"), "shard-kinds")
    remove(spark, base)

    parts, room = [], capacity
    for kind in (0, 1):
        part = _labelled(kinds.where(F.col("kind") == kind).drop("kind"), room, f"shard-linked-{kind}", kind == 0)
        parts.append(part)
        room = _rooms(room, part)
    single = numbered(kinds.where("kind = 2").drop("kind").repartitionByRange("size", "row").sortWithinPartitions("size", "row"), "number", "shard-single")
    parts.append(single.withColumn("shard", dealt(F.col("number"), sum(room), room) if sum(room) else F.lit(0)).drop("number"))
    placed = parts[0].unionByName(parts[1]).unionByName(parts[2])
    out = with_slots(placed.drop("row", "link"))
    remove(spark, kinds, single)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
