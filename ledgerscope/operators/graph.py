"""The account graph: edges, degrees, two-hop paths, scatter-gather.

A node is the struct (bank, account), with the client in front when several
clients share a table, so no edge leads from one client's accounts to another's.
Keys are never glued into one text, which could make two accounts equal.

Scatter-gather asks for pairs (s, t) of different accounts with at least k
distinct accounts m such that s pays m and m pays t. Per m that is in x out
pairs, and one m may take part in a third of all transfers. What is done:

* edges are made distinct first, then s needs k receivers and t needs k senders;
* an m with more than ``hub_paths`` pairs is a hub. Put the hubs in one order,
  hottest first. Every s leaves out its first k-1 hubs, every t as well. If s
  and t share k mids they still share one that neither has left out: of the
  shared mids, those left out on either side all belong to the account which
  left out further down the order, and that are at most k-1. So the join on m
  finds every pair, without the pairs of the hottest hubs;
* the count of a found pair is then completed exactly: mids left out on both
  sides are the overlap of two lists of at most k-1, mids left out on one side
  are looked up as edges, again at most k-1 per pair, and only for pairs which
  can still reach k;
* if accounts are asked for and not pairs, an s and a t with the same first k
  hubs are settled by that alone. Grouping by these lists settles accounts
  around many hubs without a pair, and pairs of two settled accounts are not
  looked for at all;
* a sketch of all accounts next to it travels with every account's edges. A pair whose
  sketches have no room for k shared ones is dropped inside the join, and after counting a pair
  whose left-out hubs cannot fill what it lacks; lists of hubs are fetched for the others only.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerscope.operators.filters import in_period, require_fields, usd_only
from ledgerscope.params import RiskParams
from ledgerscope.session import land

TASK_PATHS = 1 << 20  # paths of one task that counts them
MOST_TASKS = 1 << 14
SKETCH_WORDS = 8  # of 64 bits: good for accounts with up to some hundred others; beyond, fewer pairs fail the test


def _node(side: str, by: Sequence[str]) -> Column:
    return F.struct(
        *[F.col(c) for c in by],
        F.col(f"{side}_bank").alias("bank"),
        F.col(f"{side}_account").alias("account"),
    )


def transfers(tx: DataFrame, params: RiskParams) -> DataFrame:
    """USD transfers of the scatter-gather period with both ends known."""
    return require_fields(
        usd_only(tx.where(in_period(tx, params.scatter_period)), params), "edges"
    )


def distinct_edges(tx: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Edges (src, dst); repeated transfers between two accounts are one edge."""
    return tx.select(_node("from", by).alias("src"), _node("to", by).alias("dst")).distinct()


def bidirectional_edges(tx: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Each transfer seen from both ends: (node, other, is_sender)."""
    ends = F.array(
        F.struct(
            _node("from", by).alias("node"),
            _node("to", by).alias("other"),
            F.lit(True).alias("is_sender"),
        ),
        F.struct(
            _node("to", by).alias("node"),
            _node("from", by).alias("other"),
            F.lit(False).alias("is_sender"),
        ),
    )
    return tx.select(F.inline(ends))


def account_degrees(edges: DataFrame) -> DataFrame:
    """Distinct senders and receivers of every account, from distinct edges.

    Both directions go into one grouped sum, which Spark starts before it
    shuffles; no set of neighbours is ever built.
    """
    ends = F.array(
        F.struct(F.col("src").alias("node"), F.lit(0).alias("into"), F.lit(1).alias("out")),
        F.struct(F.col("dst").alias("node"), F.lit(1).alias("into"), F.lit(0).alias("out")),
    )
    return (
        edges.select(F.inline(ends))
        .groupBy("node")
        .agg(F.sum("into").alias("in_degree"), F.sum("out").alias("out_degree"))
    )


def frequent_accounts(degrees: DataFrame, k: int) -> DataFrame:
    """Accounts with at least k distinct senders or at least k distinct receivers."""
    return degrees.where((F.col("in_degree") >= k) | (F.col("out_degree") >= k))


def scatter_edges(edges: DataFrame, degrees: DataFrame, k: int) -> DataFrame:
    """Edges whose sender pays at least k accounts."""
    senders = degrees.where(F.col("out_degree") >= k).select(F.col("node").alias("src"))
    return edges.join(senders, "src", "left_semi").select("src", "dst")


def gather_edges(edges: DataFrame, degrees: DataFrame, k: int) -> DataFrame:
    """Edges whose receiver is paid by at least k accounts."""
    receivers = degrees.where(F.col("in_degree") >= k).select(F.col("node").alias("dst"))
    return edges.join(receivers, "dst", "left_semi").select("src", "dst")


def frequent_edges(edges: DataFrame, k: int) -> DataFrame:
    """Edges which may be the first or the second half of a path, by ``is_scatter``."""
    degrees = account_degrees(edges)
    return (
        scatter_edges(edges, degrees, k)
        .withColumn("is_scatter", F.lit(True))
        .unionByName(
            gather_edges(edges, degrees, k).withColumn("is_scatter", F.lit(False))
        )
    )


def _halves(edges: DataFrame, degrees: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """First halves (src, mid) and second halves (mid, dst) of the paths."""
    first, second = scatter_edges(edges, degrees, k), gather_edges(edges, degrees, k)
    return (
        first.withColumnRenamed("dst", "mid"),
        second.withColumnRenamed("src", "mid"),
    )


def _join_halves(
    first: DataFrame, second: DataFrame, hub_paths: int | None = None, lists: bool = False
) -> DataFrame:
    """Paths of the halves, with different ends.

    With ``hub_paths`` an account with more pairs than that is cut into a grid:
    its senders are spread over the rows and its receivers over the columns, so
    a cell holds about ``hub_paths`` pairs and cells are spread over the tasks.
    A sender is copied to the columns of its row and a receiver to the rows of
    its column, which is 2 / root(hub_paths) copies per pair put out.

    With ``lists`` a sender meets the list ``ends`` of all receivers of its cell, itself perhaps among them; these are
    about root(hub_paths) at most.
    """
    different = F.col("src") != F.col("dst")
    if hub_paths is None:
        return first.join(second, "mid").where(different)
    if "mid_in" in first.columns:
        return _join_cells(first, second, hub_paths).where(different)
    side = F.lit(max(float(hub_paths), 1.0) ** 0.5)
    into = first.groupBy("mid").agg(F.ceil(F.count("*") / side).alias("rows"))
    out = second.groupBy("mid").agg(F.ceil(F.count("*") / side).alias("columns"))
    grids = into.join(out, "mid").where(F.col("rows") * F.col("columns") > 1)

    def placed(half: DataFrame, end: str, own: str, other: str) -> DataFrame:
        size, copies = F.coalesce(own, F.lit(1)), F.coalesce(other, F.lit(1))
        cells = half.join(grids, "mid", "left").select(
            *half.columns,
            F.pmod(F.xxhash64(end), size).alias(f"{own}_cell"),
            F.sequence(F.lit(0).cast("bigint"), copies - 1).alias("copies"),
        )
        return cells.withColumn(f"{other}_cell", F.explode("copies")).drop("copies")

    by_row = placed(first, "src", "rows", "columns")
    by_column = placed(second, "dst", "columns", "rows")
    cell = ["mid", "rows_cell", "columns_cell"]
    if lists:
        return by_row.join(by_column.groupBy(*cell).agg(F.collect_list("dst").alias("ends")), cell)
    return by_row.join(by_column, cell).where(different).drop("rows_cell", "columns_cell")


def _join_cells(first: DataFrame, second: DataFrame, hub_paths: int) -> DataFrame:
    """The same join where ``mid_in`` and ``mid_out`` travel with the edges.

    The grid of an account is then worked out row by row: nothing is grouped or joined to learn it, and no
    key is hot before it is spread. An account that is no hub is a grid of one cell. The join is forced to
    shuffle, as the size Spark knows is that of the rows before they are copied.
    """
    side = max(float(hub_paths), 1.0) ** 0.5
    hub = F.col("mid_in").cast("double") * F.col("mid_out") > hub_paths
    cells = {
        name: F.when(hub, F.ceil(F.col(name) / side)).otherwise(F.lit(1)).cast("bigint")
        for name in ("mid_in", "mid_out")
    }

    def placed(half: DataFrame, end: str, own: str, other: str) -> DataFrame:
        rest = [c for c in half.columns if c not in cells]
        return half.select(
            *rest,
            F.pmod(F.xxhash64(end), cells[own]).alias(f"{own}_cell"),
            F.explode(F.sequence(F.lit(0).cast("bigint"), cells[other] - 1)).alias(f"{other}_cell"),
        )

    by_row = placed(first, "src", "mid_in", "mid_out")
    by_column = placed(second, "dst", "mid_out", "mid_in")
    cell = ["mid", "mid_in_cell", "mid_out_cell"]
    return by_row.join(by_column.hint("merge"), cell).drop("mid_in_cell", "mid_out_cell")


def two_hop_paths(
    edges: DataFrame, k: int, hub_paths: int | None = None, together: bool = False
) -> DataFrame:
    """All paths (src, mid, dst) with different ends, of accounts frequent enough.

    The paths themselves are the result here, so a hub yields all its in x out,
    by several tasks if ``hub_paths`` is given; `scatter_gather_pairs` counts
    them without writing them out. With ``k=1`` nothing is left out.

    With ``together`` all paths of a ``src`` come out in one partition, for whoever groups
    them by it and more: they are shuffled as lists and not one by one.
    """
    if together:
        return _paths_together(edges, k, hub_paths)
    first, second = _halves(edges, account_degrees(edges), k)
    return _join_halves(first, second, hub_paths).select("src", "mid", "dst")


def _paths_together(edges: DataFrame, k: int, hub_paths: int | None) -> DataFrame:
    """The paths, shuffled by ``src`` as rows that hold all last accounts of a cell (see `_join_halves`).

    So ``src`` is shuffled once per cell, and copies of a list follow one another, where compression finds them. A
    ``src`` has no more paths than there are edges. The number of paths, which the degrees give from above, sets the number
    of partitions: what is grouped in one of them is to fit into memory.
    """
    edges = land(edges, "edges")
    degrees = land(account_degrees(edges), "degrees")
    paths = degrees.agg(F.sum(F.col("in_degree").cast("double") * F.col("out_degree"))).first()[0] or 0.0
    parts = int(min(max(paths / TASK_PATHS, 1.0), MOST_TASKS))
    first, second = _halves(edges, degrees, k)
    side = RiskParams.hub_paths if hub_paths is None else hub_paths
    lists = _join_halves(first, second, side, lists=True).select("src", "mid", "ends")
    rows = lists.repartition(parts, "src").select("src", "mid", F.explode("ends").alias("dst"))
    return rows.where(F.col("src") != F.col("dst"))


def paths_per_account(edges: DataFrame, k: int) -> DataFrame:
    """Number of paths with different ends over every account, without joining any.

    All in x out of the account, less those which lead back to where they came from.
    """
    first, second = _halves(edges, account_degrees(edges), k)
    back = first.join(second.withColumnRenamed("dst", "src"), ["mid", "src"])
    into = first.groupBy("mid").agg(F.count("*").alias("into"))
    out = second.groupBy("mid").agg(F.count("*").alias("out"))
    returns = back.groupBy("mid").agg(F.count("*").alias("returns"))
    paths = F.col("into") * F.col("out") - F.coalesce(F.col("returns"), F.lit(0))
    counts = into.join(out, "mid").join(returns, "mid", "left")
    return counts.select("mid", paths.alias("paths")).where(F.col("paths") > 0)


def path_counts(paths: DataFrame) -> DataFrame:
    """Number of accounts between per pair; the paths are distinct already."""
    return paths.groupBy("src", "dst").agg(F.count("*").alias("mids"))


# --- search over numbered accounts ----------------------------------------------


@dataclass(frozen=True)
class NumberedGraph:
    """Edges between account numbers, with the degrees of both ends, and who is who.

    Paths outnumber edges by far, so the accounts are numbered before: pairs are
    then grouped and shuffled as two integers instead of four texts. The numbers
    are written with the accounts, hence they are the same for every reader, and go
    by falling in x out: of two accounts between, the hotter one has the smaller number.
    """

    accounts: DataFrame  # node, number, in_degree, out_degree
    edges: DataFrame  # src, dst, {src,dst}_{in,out}

    def names(self, end: str) -> DataFrame:
        return self.accounts.select(F.col("number").alias(end), F.col("node").alias(f"{end}_node"))


def _may_start(k: int) -> Column:
    """The edge may be a first half: its sender pays k accounts, its receiver pays on."""
    return (F.col("src_out") >= k) & (F.col("dst_out") > 0)


def _may_end(k: int) -> Column:
    """The edge may be a second half: its receiver is paid by k, its sender is paid too."""
    return (F.col("dst_in") >= k) & (F.col("src_in") > 0)


def number_accounts(edges: DataFrame, k: int) -> NumberedGraph:
    """Number the accounts; edges which cannot be half of a path are left out."""
    edges = land(edges, "edges")
    heat = F.col("in_degree").cast("double") * F.col("out_degree")
    accounts = land(
        account_degrees(edges).orderBy(heat.desc()).withColumn("number", F.monotonically_increasing_id()), "accounts"
    )

    def end(name: str) -> DataFrame:
        return accounts.select(
            F.col("node").alias(name),
            F.col("number").alias(f"{name}_number"),
            F.col("in_degree").alias(f"{name}_in"),
            F.col("out_degree").alias(f"{name}_out"),
        )

    numbered = (
        edges.join(end("src"), "src").join(end("dst"), "dst").where(_may_start(k) | _may_end(k))
    )
    columns = ["src_in", "src_out", "dst_in", "dst_out"]
    renamed = numbered.select(
        F.col("src_number").alias("src"), F.col("dst_number").alias("dst"), *columns
    )
    return NumberedGraph(accounts, land(renamed, "numbered-edges"))


def _load() -> Column:
    return F.col("mid_in").cast("double") * F.col("mid_out")


def _search_halves(graph: NumberedGraph, k: int) -> tuple[DataFrame, DataFrame]:
    """First halves (src, mid) and second halves (mid, dst) with the mid's degrees.

    The degrees travel with the edges, so this is a filter and not a join.
    """
    first = graph.edges.where(_may_start(k)).select(
        "src", F.col("dst").alias("mid"), F.col("dst_in").alias("mid_in"), F.col("dst_out").alias("mid_out")
    )
    second = graph.edges.where(_may_end(k)).select(
        F.col("src").alias("mid"), "dst", F.col("src_in").alias("mid_in"), F.col("src_out").alias("mid_out")
    )
    return first, second


def has_hubs(graph: NumberedGraph, hub_paths: int | None) -> bool:
    """Is there an account with more than ``hub_paths`` paths through it?

    As in + out is at least twice the root of in x out, there are at most
    edges / root(hub_paths) such accounts.
    """
    if hub_paths is None:
        return False
    load = F.col("in_degree").cast("double") * F.col("out_degree")
    return not graph.accounts.where(load > hub_paths).isEmpty()


def _with_sketch(half: DataFrame, end: str, k: int, hub_paths: int) -> DataFrame:
    """The half with what the account ``end`` has besides: ``{end}_bits``, ``{end}_spare``, ``{end}_left`` and ``place``.

    The bits are a sketch of all its accounts between, one bit each; ``spare`` is by how many these exceed the bits that
    are set; ``left`` has the bits of its first k-1 hubs. Places count its hubs from the hottest one; what is no hub has
    none. One sort by account gives all of it, and an account's rows may spill.
    """
    hottest = Window.partitionBy(end).orderBy("mid")
    whole = hottest.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = half.select(
        "*",
        F.pmod(F.xxhash64("mid"), F.lit(64 * SKETCH_WORDS)).cast("int").alias("bit"),
        F.when(_load() > hub_paths, F.row_number().over(hottest)).alias("place"),
    )
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit") % 64)
    words = [F.when(F.floor(F.col("bit") / 64) == i, one).otherwise(F.lit(0)) for i in range(SKETCH_WORDS)]
    rows = rows.select(
        *half.columns,
        "place",
        F.count("*").over(whole).alias("mids"),
        F.collect_list(F.when(F.col("place") < k, F.col("bit"))).over(whole).alias(f"{end}_left"),
        F.array(*[F.bit_or(word).over(whole) for word in words]).alias(f"{end}_bits"),
    )
    spare = F.col("mids") - reduce(add, [F.bit_count(F.get(f"{end}_bits", F.lit(i))) for i in range(SKETCH_WORDS)])
    return rows.withColumn(f"{end}_spare", spare).drop("mids")


def _may_share(k: int) -> Column:
    """The sketches of a pair leave room for k accounts between.

    Different bits of what they share are set in both sketches, and what shares a bit with another one
    is spare at either end; so no pair with k accounts between fails.
    """
    word = [[F.get(f"{end}_bits", F.lit(i)) for end in ("src", "dst")] for i in range(SKETCH_WORDS)]
    same = [F.bit_count(a.bitwiseAND(b)) for a, b in word]
    return reduce(add, same) + F.least("src_spare", "dst_spare") >= k


def _left_out_at_most(k: int) -> Column:
    """No pair shares more accounts that were left out: all belong to one end, and their bits are set at the other."""

    def known(end: str, other: str) -> Column:
        hubs = [F.get(f"{end}_left", F.lit(i)) for i in range(k - 1)]
        words = [F.get(f"{other}_bits", F.floor(bit / 64).cast("int")) for bit in hubs]
        shared = [F.call_function("shiftright", word, bit % 64).bitwiseAND(F.lit(1)) for word, bit in zip(words, hubs)]
        return reduce(add, [F.coalesce(one, F.lit(0).cast("long")) for one in shared], F.lit(0).cast("long"))

    return F.greatest(known("src", "dst"), known("dst", "src"))


def _first_hubs(half: DataFrame, end: str, k: int) -> DataFrame:
    """Per account ``end`` its first k hubs as a sorted list of numbers, hottest first."""
    return half.where(F.col("place") <= k).groupBy(end).agg(F.sort_array(F.collect_list("mid")).alias("hubs"))


def _settled(own: DataFrame, others: DataFrame, end: str, other_end: str, k: int) -> DataFrame:
    """Accounts for which another one at the other end has the same first k hubs."""
    full = F.size("hubs") == k
    groups = (
        others.where(full)
        .groupBy("hubs")
        .agg(F.count("*").alias("members"), F.min(other_end).alias("member"))
    )
    partner = (F.col("members") > 1) | (F.col("member") != F.col(end))
    return own.where(full).join(groups, "hubs").where(partner).select(end)


def _without_first(half: DataFrame, k: int) -> DataFrame:
    """Drop the edges to the first k-1 hubs of every account."""
    return half.where(F.col("place").isNull() | (F.col("place") >= k)).drop("place")


def _found(paths: DataFrame, k: int) -> DataFrame:
    """Pairs that may have k accounts between, with ``kept``, the number of their paths that were joined.

    The sketches are tested within the join, so the paths of other pairs are not shuffled; of the rest
    numbers go into the shuffle and no lists.
    """
    return (
        paths.where(_may_share(k))
        .select("src", "dst", _left_out_at_most(k).alias("more"))
        .groupBy("src", "dst")
        .agg(F.count("*").alias("kept"), F.max("more").alias("more"))
        .where(F.col("kept") + F.col("more") >= k)
        .drop("more")
    )


def _complete(
    found: DataFrame, src_hubs: DataFrame, dst_hubs: DataFrame, edges: DataFrame, k: int, exact: bool
) -> DataFrame:
    """Pairs with k accounts between, from pairs counted without the hubs left out.

    ``mids`` is their number if ``exact``; otherwise nothing more is asked about
    a pair that has enough already. The lists of hubs are fetched for these pairs only.
    """

    def left_out(hubs: DataFrame, end: str) -> DataFrame:
        return hubs.select(end, F.slice("hubs", 1, k - 1).alias(f"{end}_hubs"))

    found = found.join(left_out(src_hubs, "src"), "src", "left").join(left_out(dst_hubs, "dst"), "dst", "left")

    def listed(name: str) -> Column:
        return F.coalesce(F.col(name), F.array())

    # A hub left out by one account only is worth asking for if the other one
    # may have kept it: that one left out all it could, and all of them hotter.
    def kept_elsewhere(name: str, other: str) -> Column:
        full = F.size(listed(other)) == k - 1
        cooler = F.filter(listed(name), lambda hub: hub > F.array_max(other))
        return F.when(full, cooler).otherwise(F.array())

    asked = F.concat(
        F.transform(
            kept_elsewhere("dst_hubs", "src_hubs"),
            lambda hub: F.struct(F.col("src").alias("a"), hub.alias("b")),
        ),
        F.transform(
            kept_elsewhere("src_hubs", "dst_hubs"),
            lambda hub: F.struct(hub.alias("a"), F.col("dst").alias("b")),
        ),
    )
    both = F.size(F.array_intersect(listed("src_hubs"), listed("dst_hubs")))
    known = found.select("src", "dst", (F.col("kept") + both).alias("mids"), asked.alias("asked"))
    open_pairs = land(known.where(F.col("mids") + F.size("asked") >= k), "open-pairs")
    asking = open_pairs if exact else open_pairs.where(F.col("mids") < k)
    more = (
        asking.select("src", "dst", F.inline("asked"))
        .join(edges.select(F.col("src").alias("a"), F.col("dst").alias("b")), ["a", "b"])
        .select("src", "dst", F.lit(1).cast("bigint").alias("mids"))
    )
    return (
        open_pairs.select("src", "dst", "mids")
        .unionByName(more)
        .groupBy("src", "dst")
        .agg(F.sum("mids").alias("mids"))
        .where(F.col("mids") >= k)
    )


def _plain_pairs(first: DataFrame, second: DataFrame, k: int) -> DataFrame:
    paths = _join_halves(first.drop("mid_in", "mid_out"), second.drop("mid_in", "mid_out"))
    return path_counts(paths).where(F.col("mids") >= k)


def _ranked(first: DataFrame, second: DataFrame, k: int, hub_paths: int) -> tuple[DataFrame, DataFrame]:
    return (
        land(_with_sketch(first, "src", k, hub_paths), "ranked-first"),
        land(_with_sketch(second, "dst", k, hub_paths), "ranked-second"),
    )


def _named_pairs(edges: DataFrame, params: RiskParams, prune: bool, exact: bool) -> DataFrame:
    k = params.min_intermediaries
    needed = k if prune else 1
    graph = number_accounts(edges, needed)
    first, second = _search_halves(graph, needed)
    if has_hubs(graph, params.hub_paths):
        first, second = _ranked(first, second, k, params.hub_paths)
        paths = _join_halves(_without_first(first, k), _without_first(second, k), params.hub_paths)
        hubs = _first_hubs(first, "src", k), _first_hubs(second, "dst", k)
        pairs = _complete(_found(paths, k), *hubs, graph.edges, k, exact)
    else:
        pairs = _plain_pairs(first, second, k)
    named = pairs.join(graph.names("src"), "src").join(graph.names("dst"), "dst")
    return named.select(F.col("src_node").alias("src"), F.col("dst_node").alias("dst"), "mids")


def scatter_gather_pairs(edges: DataFrame, params: RiskParams, prune: bool = True) -> DataFrame:
    """Pairs (src, dst) of nodes with at least k distinct accounts between them.

    ``prune`` and ``hub_paths`` change the work, never the result; with
    ``hub_paths=None`` hubs are joined like other accounts.
    """
    return _named_pairs(edges, params, prune, exact=False).drop("mids")


def scatter_gather_counts(edges: DataFrame, params: RiskParams, prune: bool = True) -> DataFrame:
    """The same pairs with ``mids``, the number of accounts between them."""
    return _named_pairs(edges, params, prune, exact=True)


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("src", "dst")).alias("number"))


def scatter_gather_nodes(edges: DataFrame, params: RiskParams, prune: bool = True) -> DataFrame:
    """The distinct accounts at either end of such a pair."""
    k = params.min_intermediaries
    needed = k if prune else 1
    graph = number_accounts(edges, needed)
    first, second = _search_halves(graph, needed)
    if has_hubs(graph, params.hub_paths):
        numbers = _nodes_around_hubs(first, second, graph, k, params.hub_paths)
    else:
        numbers = _ends(_plain_pairs(first, second, k))
    return graph.accounts.join(numbers.distinct(), "number", "left_semi").select("node.*")


def _nodes_around_hubs(
    first: DataFrame, second: DataFrame, graph: NumberedGraph, k: int, hub_paths: int
) -> DataFrame:
    first, second = _ranked(first, second, k, hub_paths)
    src_hubs = land(_first_hubs(first, "src", k), "src-hubs")
    dst_hubs = land(_first_hubs(second, "dst", k), "dst-hubs")
    src_done = land(_settled(src_hubs, dst_hubs, "src", "dst", k), "src-settled")
    dst_done = land(_settled(dst_hubs, src_hubs, "dst", "src", k), "dst-settled")
    first, second = _without_first(first, k), _without_first(second, k)
    open_first = first.join(src_done, "src", "left_anti")
    done_first = first.join(src_done, "src", "left_semi")
    open_second = second.join(dst_done, "dst", "left_anti")
    paths = _join_halves(open_first, second, hub_paths).unionByName(
        _join_halves(done_first, open_second, hub_paths)
    )
    settled = src_done.toDF("number").unionByName(dst_done.toDF("number"))
    found = _found(paths, k)
    return settled.unionByName(_ends(_complete(found, src_hubs, dst_hubs, graph.edges, k, exact=False)))


def path_endpoints(pairs: DataFrame) -> DataFrame:
    """Two rows per pair: its first and its last account."""
    return pairs.select(F.explode(F.array("src", "dst")).alias("node")).select("node.*")


def distinct_accounts(nodes: DataFrame) -> DataFrame:
    return nodes.distinct()
