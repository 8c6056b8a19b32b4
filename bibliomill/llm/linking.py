"""Components of links that are found through shared groups and verified pair by pair.

Rows that ask in a group are to be compared with the rows that are told of in it.  All pairs of
a group would grow with its square, so rounds go before them: each asking node is
compared with two leaders of its groups, rows of other components: of all leaders it may take, the
one that meets most others and the one that meets fewest.  The first leaders are the nodes that
meet most others, as the text does that the others of a group were copied from; later ones are
drawn anew each round.  What is linked becomes one component, and pairs inside a component need no comparison.  As soon as the pairs
left are few for the rows that ask, or a round links few of its pairs, all of them are
compared.  The neighbours of a first leader, within twice the greatest distance of a link, are compared
with each other at once, in tiles of bounded size that hold each set once; tiles whose
distances to the leader are too far apart are passed over, as likeness distance is a metric.
Where very many pairs are left even so, as in a crowd that shares one passage and is not
alike, the caller may give finer groups that still bring every alike pair together.  Nothing is left
out: only pairs that are already connected, or were compared before, are passed over.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bibliomill.llm.common import broadcast_up_to, cut_lineage, group_edges, shuffle_width, whole_groups

GROUP = ["sig", "kind"]
# Pairs left for each asking row below which they are compared at once.
FEW = 16
# A round that links less than this part of its pairs is the last one with leaders.
USEFUL = 0.1
# Members compared with one copy of a hub's set.
STAR = 512
# Sets of a tile of neighbours, numbers compared at once, and holders up to which a number is
# counted by itself.
TILE = 1024
COLUMNS = 1024
RARE = 24
# Nodes whose sets are found by a broadcast of their keys.
KNOWN = 2_000_000
# Numbers put last by frequency when a crowd is compared by its rarest ones; any number gives
# the same links.
COMMON = 50_000


def verified(pairs: DataFrame, sets: DataFrame, alike: Callable[[int, int, int], bool], dtype: str) -> DataFrame:
    """Likeness of the pairs (a, b, hub), and whether their sets (node, set: sorted numbers of
    ``dtype`` as bytes) are alike by ``alike(size, size, shared)``.

    The set of a hub is sent once for every ``STAR`` of its partners, and these follow it as a
    stream, so that a hub of any number of partners fills many tasks and is held once.
    """
    partners = pairs.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / STAR).alias("chunks"))
    dealt = pairs.join(partners, "hub").select(
        "hub", F.when(F.col("hub") == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("node"), F.col("chunks")
    ).withColumn("chunk", F.pmod(F.xxhash64("node"), "chunks")).drop("chunks")
    hubs = dealt.select("hub", "chunk", F.col("hub").alias("node")).distinct().withColumn("partner", F.lit(False))
    order = ["hub", "chunk", "partner"]
    # one join, so that the sets are shuffled once
    rows = dealt.withColumn("partner", F.lit(True)).unionByName(hubs).join(sets, "node").select(*order, "node", "set")
    rows = rows.repartition(shuffle_width(pairs.sparkSession), "hub", "chunk").sortWithinPartitions(*order)

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hub, held = None, np.empty(0, dtype)
        for batch in batches:
            out = []
            for of, partner, node, numbers in zip(batch["hub"], batch["partner"], batch["node"], batch["set"]):
                mine = np.frombuffer(numbers, dtype)
                if not partner:
                    hub, held = of, mine
                elif hub == of:
                    small, large = (mine, held) if len(mine) <= len(held) else (held, mine)
                    at = np.searchsorted(large, small)
                    at[at == len(large)] = 0
                    shared = int((large[at] == small).sum()) if len(large) else 0
                    out.append((min(of, node), max(of, node), of, alike(len(mine), len(held), shared), shared / max(1, len(mine) + len(held) - shared)))
            yield pd.DataFrame(out, columns=["a", "b", "hub", "linked", "likeness"])

    return rows.mapInPandas(compare, "a long, b long, hub long, linked boolean, likeness double")


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Numbers that each pair of sets has in common."""
    out = np.zeros((len(sets), len(sets)), np.float32)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    numbers, place, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    often = np.cumsum(n > RARE) - 1
    for lo in range(0, int((n > RARE).sum()), COLUMNS):
        here = (n[place] > RARE) & (often[place] >= lo) & (often[place] < lo + COLUMNS)
        has = np.zeros((len(sets), COLUMNS), np.float32)
        has[owner[here], often[place[here]] - lo] = 1
        out += has @ has.T
    few = (n[place] > 1) & (n[place] <= RARE)
    order = np.argsort(place[few], kind="stable")
    holders, of = owner[few][order], place[few][order]
    edges = np.flatnonzero(np.append(True, of[1:] != of[:-1])) if len(of) else np.empty(0, np.int64)
    for lo, hi in zip(edges, np.append(edges[1:], len(of))):
        out[np.ix_(holders[lo:hi], holders[lo:hi])] += 1
    return out


def star_links(members: DataFrame, sets: DataFrame, alike: Callable[[int, int, int], bool], dtype: str, least: float) -> DataFrame:
    """Links (a, b) that join the components of the members (star, node, root, distance), as far
    as those of one star are linked with each other."""
    order = Window.partitionBy("star").orderBy("distance", "node")
    placed = members.withColumn("tile", F.floor((F.row_number().over(order) - 1) / TILE))
    near, far = F.min("distance").alias("near"), F.max("distance").alias("far")
    tiles = placed.groupBy("star", "tile").agg(near, far)
    other = tiles.select("star", F.col("tile").alias("visit"), F.col("near").alias("from"))
    # each pair of tiles once, the farther one visiting
    meeting = tiles.join(other, "star").where((F.col("visit") >= F.col("tile")) & (F.col("from") - F.col("far") <= 1 - least + 1e-9)).select("star", F.col("tile").alias("home"), "visit")
    both = [placed.join(meeting.withColumnRenamed("home", "tile"), ["star", "tile"]).select("star", F.col("tile").alias("home"), "visit", "node", "root")]
    both.append(placed.withColumnRenamed("tile", "visit").join(meeting.where("home <> visit"), ["star", "visit"]).select("star", "home", "visit", "node", "root"))
    keys = ["star", "home", "visit"]
    dealt = both[0].unionByName(both[1]).join(sets, "node").repartition(shuffle_width(members.sparkSession), *keys).sortWithinPartitions(*keys)

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in whole_groups(batches, keys):
            out = []
            for lo, hi in group_edges(part, keys):
                rows = part.iloc[lo:hi]
                label, node = np.unique(rows["root"], return_inverse=True)[1], rows["node"].to_numpy()
                if label.max() == 0:
                    continue
                held = [np.frombuffer(b, dtype) for b in rows["set"]]
                shared, size = shared_counts(held), np.array([len(h) for h in held])
                for i in range(len(held)):
                    likely = shared[i] >= (least - 1e-3) * (size + size[i] - shared[i])
                    for j in np.flatnonzero(likely & (label != label[i])):
                        if label[j] != label[i] and alike(int(size[i]), int(size[j]), int(shared[i, j])):
                            out.append((int(node[i]), int(node[j])))
                            label[label == label[j]] = label[i]
            yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return dealt.mapInPandas(compare, "a long, b long")


def connected(
    rows: DataFrame,
    sets_for: Callable[[DataFrame], DataFrame],
    alike: Callable[[int, int, int], bool],
    dtype: str,
    least: float,
    chosen: Callable[[DataFrame], DataFrame] | None = None,
    finer: Callable[[DataFrame], DataFrame] | None = None,
    sharing: Callable[[DataFrame], DataFrame] | None = None,
    crowded: int | None = None,
) -> DataFrame:
    """``node`` and ``root``, the smallest node reachable, of the nodes with a smaller one.

    ``rows(sig, kind, node, size, asks, told, crowd, ...)`` is a written table, ``crowd`` about the
    number of rows of the group, from which first leaders are drawn; ``sets_for(nodes)``, called
    once, gives the sets (node, set) of all nodes that may be compared, ``alike(size, size, shared)`` the links, of Jaccard likeness
    ``least`` or more, and ``chosen`` may pass over asking rows by their cost (``foreign``, the
    rows of other components that they meet); what it chose is asked in all later rounds.
    ``finer`` makes such rows of the sets of crowds, where more than ``crowded`` pairs (``FEW``) are
    left for each asking row, and ``sharing`` keeps those of their pairs (a, b, hub) that ``rows``
    bring together too.
    """
    from bibliomill.llm.simhash import components

    roots, links, tested, stars, sets = None, None, None, None, None
    last, refined, turn = False, False, 0

    def sets_of(nodes: DataFrame) -> DataFrame:
        return sets.join(broadcast_up_to(nodes, KNOWN), "node", "left_semi")

    def fits(a: Column, b: Column) -> Column:
        return F.least(a, b) >= (least - 1e-9) * F.greatest(a, b)

    while True:
        turn += 1
        # what is known of the nodes: component, star, and in a first round how central they are
        labels = [frame for frame in (roots, stars) if frame is not None]
        if turn == 1:
            labels.append(rows.where("told").groupBy("node").agg(F.sum("crowd").alias("met")))
        known = reduce(lambda x, y: x.join(y, "node", "full_outer"), labels) if labels else None
        labelled = rows if known is None else rows.join(known, "node", "left")
        for label in ("root", "star"):
            labelled = labelled.withColumn(label, F.coalesce(label, "node") if label in labelled.columns else F.col("node"))
        labelled = cut_lineage(labelled, "labelled")
        draw = -F.coalesce("met", F.lit(0)) if turn == 1 else F.xxhash64("node", F.lit(turn))
        drawn = F.struct(draw.alias("draw"), "root", "node", "size")
        if turn == 1:
            # every node is a component of its own
            whole = labelled.where("told").groupBy(*GROUP).agg(F.count(F.lit(1)).alias("all"), F.min(drawn).alias("leader"))
            asking = labelled.where("asks").join(whole, GROUP).withColumn("own", F.col("told").cast("long"))
        else:
            told = labelled.where("told").groupBy(*GROUP, "root").agg(F.count(F.lit(1)).alias("own"), F.min(drawn).alias("leader"))
            told = cut_lineage(told, "told")
            whole = told.groupBy(*GROUP).agg(F.sum("own").alias("all"), F.min("leader").alias("leader"), F.min("root").alias("low"), F.max("root").alias("high"))
            asking = labelled.where("asks").join(whole, GROUP).where("low < high OR low <> root").drop("low", "high")
            asking = asking.join(told.select(*GROUP, "root", "own"), [*GROUP, "root"], "left")
        foreign = F.col("all") - F.coalesce("own", F.lit(0))
        if stars is not None:
            compared = labelled.where("told").groupBy(*GROUP, "star").agg(F.count(F.lit(1)).alias("of_star"))
            asking = asking.join(compared, [*GROUP, "star"], "left")
            foreign = F.least(foreign, F.col("all") - F.coalesce("of_star", F.lit(0)))
        asking = asking.withColumn("foreign", foreign).drop("own", "all", "met", "of_star").where("foreign > 0")
        asking = cut_lineage(chosen(asking) if chosen else asking, "asking")
        n, left = asking.agg(F.count(F.lit(1)), F.coalesce(F.sum("foreign"), F.lit(0))).first()
        if not n:
            break
        if turn > 1 and finer and left > min(FEW, FEW if crowded is None else crowded) * n:
            # those asked of need not ask themselves
            met = labelled.where("told").join(asking.select(*GROUP).distinct(), GROUP, "left_semi").select("node")
            crowd = cut_lineage(met.unionByName(asking.select("node")).distinct(), "crowd")
            rows, finer, last, refined = cut_lineage(finer(sets_of(crowd)), "finer"), None, False, True
            continue
        last = last or left <= FEW * n
        if chosen and not last:
            rows, chosen = cut_lineage(still_asking(rows, asking.select(*rows.columns)), "rows"), None
        mine = [*GROUP, "node", "size", "root", "star"]
        if last:
            own = [*mine[len(GROUP) :], "place"] if refined else mine[len(GROUP) :]
            others = labelled.where("told").select(*GROUP, *[F.col(c).alias("hub" if c == "node" else f"hub_{c}") for c in own])
            met = asking.select(*GROUP, *own).join(others, GROUP).where("hub_root <> root AND hub_star <> star")
            if refined:
                # what follows the first number in common must be enough for a link
                most = F.least(F.col("size") - F.col("place"), F.col("hub_size") - F.col("hub_place"))
                met = met.where(most >= least / (1 + least) * (F.col("size") + F.col("hub_size")) - 1e-6)
        else:
            led, hub = asking.select(*mine, "leader"), F.when(F.col("leader.root") != F.col("root"), F.col("leader"))
            if turn > 1:
                # a row of the first leader's component takes the first leader of another one
                firsts = whole.where("low < high").select(*GROUP, F.col("leader.root").alias("first"))
                second = told.join(firsts, GROUP).where("root <> first").groupBy(*GROUP).agg(F.min("leader").alias("second"))
                led, hub = led.join(second, GROUP, "left"), F.coalesce(hub, F.col("second"))
            led = led.withColumn("lead", hub).where("lead IS NOT NULL").where(fits(F.col("size"), F.col("lead.size")))
            both = led.groupBy("node", "size").agg(F.array(F.min("lead"), F.max("lead")).alias("leads")).select("node", "size", F.explode(F.array_distinct("leads")).alias("lead"))
            met = both.select("node", "size", F.col("lead.node").alias("hub"), F.col("lead.size").alias("hub_size"))
        ends = [F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")]
        pairs = met.where(fits(F.col("size"), F.col("hub_size"))).select(*ends, "hub").groupBy("a", "b").agg(F.min("hub").alias("hub"))
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        if refined and sharing:
            pairs = sharing(pairs)
        pairs = cut_lineage(pairs, "pairs")
        ends = cut_lineage(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "nodes")
        if sets is None:
            sets = sets_for(ends if last else rows.select("node").distinct())
        found = cut_lineage(verified(pairs, sets_of(ends), alike, dtype), "links")
        linked = found.where("linked").select("a", "b")
        links = linked if links is None else links.unionByName(linked)
        tested = found.select("a", "b") if tested is None else tested.unionByName(found.select("a", "b"))
        n_pairs, n_found = found.agg(F.count(F.lit(1)), F.count_if("linked")).first()
        if n_found:
            roots = components(links)
        if last:
            break
        last = n_found <= USEFUL * n_pairs
        if turn == 1 and n_found and stars is None:
            stars, members = neighbourhoods(found, roots, 2 * least - 1)
            joined = cut_lineage(star_links(members, sets_of(members.select("node").distinct()), alike, dtype, least), "star_links")
            if not joined.isEmpty():
                links = links.unionByName(joined)
                roots = components(links)
    return roots if roots is not None else rows.select("node", F.col("node").alias("root")).limit(0)


def still_asking(rows: DataFrame, asking: DataFrame) -> DataFrame:
    """The chosen asking rows, and those told of in their groups.  What a node meets only grows
    fewer by rounds, so nothing else ever has to be asked."""
    no = F.lit(False)
    both = rows.where("told").withColumn("asks", no).unionByName(asking.withColumn("told", no))
    asked = F.max("asks").over(Window.partitionBy(*GROUP))
    return both.withColumn("_asked", asked).where("_asked").drop("_asked")


def rare_members(sets: DataFrame, dtype: str, least: float) -> DataFrame:
    """Groups of the sets (node, set) that share one of their rarest numbers, and the place
    of that number among all of the set, the rarest first.

    In any one order of all numbers two alike sets share one of the first of each, as many as
    may differ and one more.  The order puts the ``COMMON`` most frequent numbers of these
    sets last, so a passage that many of them share brings nobody together.
    """

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            met, n = np.unique(np.concatenate([np.frombuffer(b, dtype) for b in batch["set"]] or [np.empty(0, dtype)]), return_counts=True)
            yield pd.DataFrame({"number": met.astype(np.int64), "n": n})

    counts = sets.select("set").mapInPandas(counted, "number long, n long").groupBy("number").agg(F.sum("n").alias("n"))
    common = np.array([r[0] for r in counts.where("n > 1").orderBy(F.desc("n"), "number").limit(COMMON).select("number").collect()], np.int64).astype(dtype)

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        by_number = np.argsort(common)
        for batch in batches:
            out = []
            for node, numbers in zip(batch["node"], batch["set"]):
                mine = np.frombuffer(numbers, dtype)
                place = np.searchsorted(common, mine, sorter=by_number)
                place[place == len(common)] = 0
                known = common[by_number[place]] == mine if len(common) else np.zeros(len(mine), bool)
                # the most frequent come last of all
                rank = np.where(known, len(common) - by_number[place] if len(common) else 0, 0)
                take = len(mine) - int(np.ceil(least * len(mine) - 1e-9)) + 1
                rarest = mine[np.lexsort((mine, rank))[:take]]
                out.append(pd.DataFrame({"sig": rarest.astype(np.int64), "node": node, "size": len(mine), "place": np.arange(len(rarest))}))
            yield pd.concat(out, ignore_index=True) if out else pd.DataFrame({"sig": [], "node": [], "size": [], "place": []}, dtype="int64")

    rows = sets.mapInPandas(first, "sig long, node long, size long, place long")
    shared = rows.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("sig"))).where("n > 1")
    return shared.select("sig", F.lit(0).alias("kind"), "node", "size", "place", F.lit(True).alias("asks"), F.lit(True).alias("told"), F.col("n").alias("crowd"))


def neighbourhoods(found: DataFrame, roots: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """The star (a leader) of every node that is within reach of one, that of most nodes, and
    the members (star, node, root, distance) of the stars of several components."""
    near = found.where(F.col("likeness") >= least - 1e-9)
    reached = near.select("hub", F.when(F.col("hub") == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("node"), (1 - F.col("likeness")).alias("distance"))
    reached = reached.unionByName(reached.select("hub", F.col("hub").alias("node"), F.lit(0.0).alias("distance")).distinct())
    ranked = reached.join(reached.groupBy("hub").agg(F.count(F.lit(1)).alias("n")), "hub")
    best = ranked.groupBy("node").agg(F.max(F.struct("n", "hub", "distance")).alias("s")).select("node", F.col("s.hub").alias("star"), F.col("s.distance").alias("distance"))
    best = cut_lineage(best, "stars")
    rooted = best.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    several = rooted.groupBy("star").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("star")
    return best.select("node", "star"), cut_lineage(rooted.join(several, "star"), "members")
