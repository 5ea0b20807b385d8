"""Leakage-safe splits, samples that engines can reproduce, and donors for permutation.

Random choices come from md5 of the seed and the row's key, so any engine, and any partitioning, draws alike.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hazeline.functions.checks import described, failing
from hazeline.functions.packing import pack, unpack
from hazeline.functions.prefix import running_sums
from hazeline.functions.quantiles import exact_quantiles
from hazeline.functions.ranks import large_groups, running_totals
from hazeline.sources.sinks import stored


def draw(*parts: Column | str) -> Column:
    """A number of 32 bits from the md5 of parts joined by '|'."""
    text = F.concat_ws("|", *[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")


def month_tail_split(time: Column, val_days: int = 3, test_days: int = 3, gap_hours: int = 24) -> Column:
    """train, val or test by the day of the month: test at its end, val before it, gaps between; null in a gap and
    in months that are too short."""
    if gap_hours % 24:
        raise ValueError(f"gap_hours must be a multiple of 24: {gap_hours}")
    gap = gap_hours // 24
    day, days = F.dayofmonth(time), F.dayofmonth(F.last_day(time))
    test_from = days - test_days + 1
    val_to = test_from - gap - 1
    val_from = val_to - val_days + 1
    train_to = val_from - gap - 1
    return F.when(train_to < 1, None).when(day >= test_from, "test").when((day >= val_from) & (day <= val_to), "val").when(day <= train_to, "train")


def split_leakage(df: DataFrame, key: Sequence[str], split: str = "split") -> DataFrame:
    """Keys in two splits or more."""
    return df.groupBy(*key).agg(F.count_distinct(split).alias("n_splits")).filter(F.col("n_splits") > 1)


def merge_splits(df: DataFrame, names: Sequence[str], into: str, split: str = "split") -> DataFrame:
    return df.withColumn(split, F.when(F.col(split).isin(*names), into).otherwise(F.col(split)))


def uniform_sample(df: DataFrame, key: Sequence[str], n: int, seed: str, min_events: int = 0, event: Column | None = None, by: Sequence[str] = ()) -> DataFrame:
    """n rows of each group without replacement, by the order of draw(seed, key): a top-k, taken within hash ranges first, so
    that a group may hold all rows. Fails with under min_events events in a group."""
    placed = df.withColumn("_d", draw(seed, *[F.col(k) for k in key]))
    for part in ([F.pmod("_d", F.lit(64))], []):
        w = Window.partitionBy(*by, *part).orderBy("_d", *key)
        placed = placed.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n)
    chosen = placed.drop("_d", "_r")
    if not min_events or event is None:
        return chosen
    few = chosen.groupBy(*by).agg(F.count_if(event).alias("_n")).filter(F.col("_n") < min_events)
    return failing(chosen, few, described(F.col("_n"), f" events in the sample; {min_events} are needed"))


def even_sample(values: DataFrame, column: str, n: int) -> DataFrame:
    """The values at n evenly spaced ranks of the distinct ascending values, first and last among them.

    Values are numbered by ranges; only the ranges' counts are summed in one place."""
    distinct = values.select(column).distinct()
    total = distinct.agg(F.count("*").alias("_total"))  # one row
    ranked = running_totals(distinct, [], [column], {"_rank": F.lit(1).cast("long")}, lambda d: stored(d, "value-ranges"))
    # The i-th of n ranks is floor(i * step + 1e-9): the value of rank r is taken where some i gives r.
    step = (F.col("_total") - 1) / float(max(n - 1, 1))
    i = F.greatest(F.ceil(F.try_divide(F.col("_rank") - 1 - 1e-9, step)), F.lit(0))
    taken = (F.col("_total") <= n) | ((i < n) & (F.floor(i * step + 1e-9) == F.col("_rank") - 1))
    return ranked.crossJoin(F.broadcast(total)).filter(taken).select(column)


def class_balanced_sample(
    df: DataFrame, key: str, n_batches: int, batch: int, seed: str, shares: Sequence[float] = (0.18, 0.22), by: Sequence[str] = ()
) -> DataFrame:
    """by, batch, slot, y_cls, key: slots of each batch dealt to the classes by their shares (the rest clear), each filled with
    replacement from its class by draw modulo the class's size."""
    sizes = df.groupBy(*by, "y_cls").agg(F.count("*").alias("n"))
    rows = df.select(*by, "y_cls", key, draw(seed, F.col(key)).alias("_d"), F.lit(1).alias("_one"))
    ranked = running_sums(rows, [*by, "y_cls"], F.floor(F.col("_d") / (1 << 22)), F.struct("_d", key), {"_rank": "_one"})
    fog, mist = round(batch * shares[0]), round(batch * shares[1])
    slots = df.sparkSession.range(n_batches * batch).select(F.floor(F.col("id") / batch).alias("batch"), F.pmod("id", F.lit(batch)).alias("slot"))
    slots = slots.withColumn("y_cls", F.when(F.col("slot") < fog, 0).when(F.col("slot") < fog + mist, 1).otherwise(2))
    slots = slots.join(sizes, "y_cls").withColumn("_rank", F.pmod(draw(seed, F.col("batch"), F.col("slot")), F.col("n")) + 1)
    return slots.join(ranked, [*by, "y_cls", "_rank"]).select(*by, "batch", "slot", "y_cls", key)


#: Rows of a stratum up to which one task permutes it in memory; larger strata are permuted by chunks of about as many.
IN_MEMORY = 100_000
#: Buckets of draws a chunk; cells that strata are counted by before they are told apart.
BUCKETS, CELLS = 8, 1 << 16


def _place(seed: Column | str, key: Column) -> Column:
    """As draw, as eight hexadecimal digits, which have the same order."""
    return F.substring(F.md5(F.concat_ws("|", F.lit(seed) if isinstance(seed, str) else seed, key.cast("string")).cast("binary")), 1, 8)


def donors(df: DataFrame, key: str, seed: Column | str, strata: Sequence[str] = ()) -> DataFrame:
    """strata, key, donor: a permutation of the keys within each stratum: the i-th key gets the i-th in draw order.

    Strata of many rows are permuted by chunks of ranks, so one may hold all rows; the others on one shuffle."""
    if not strata:
        return donors(df.withColumn("_all", F.lit(0)), key, seed, ["_all"]).drop("_all")
    carried = ["_seed"] if isinstance(seed, Column) else []
    rows = df.select(*strata, key, *([seed.alias("_seed")] if carried else []))
    return permuted_rows(rows, key, [F.col("_seed") if carried else seed], strata, carried).select(*strata, key, "donor")


def permuted_rows(df: DataFrame, key: str, seeds: Sequence[Column | str], strata: Sequence[str], own: Sequence[str] = (), given: Sequence[str] = ()) -> DataFrame:
    """strata, own, key, donor, _given, _rep, _n: for each of seeds (_rep from 0) a permutation within each stratum: the i-th row gets, as
    _given, the columns given of the row that is the i-th in the order of draw(seed, key); _n: the rows of the stratum.

    Seeds may name columns of own. A row is moved once where its stratum has IN_MEMORY rows or fewer, and all of the stratum is in one task. A
    larger stratum is cut into chunks of ranks and a row is moved to that of its own rank and those of its ranks as a donor, packed and
    without its draws, which are made again: counts by buckets of draws, made before, tell the ranks. The few buckets that lie across
    the ends of a chunk are moved twice. No task holds more than some chunks.
    """
    large = _large_strata(df, strata)
    columns = [*strata, *own, key, "donor", "_given", "_rep", "_n"]
    same = _same_strata(strata)
    if large.isEmpty():
        return _in_tasks(df, key, seeds, strata, own, given).select(columns)
    small = _in_tasks(df.join(F.broadcast(large), same, "left_anti"), key, seeds, strata, own, given).select(columns)
    tagged = df.join(F.broadcast(large), same)
    return small.union(_in_chunks(tagged, large, key, seeds, strata, own, given).select(columns))


def _same_strata(strata: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in strata])


def _large_strata(df: DataFrame, strata: Sequence[str]) -> DataFrame:
    """_of_<strata>, _g (a number), _n and _width (of a bucket of draws) of the strata of more than IN_MEMORY rows, a row in as many.

    Rows are counted by cells of strata first, which combine before they are shuffled; only strata of a large cell are counted one by one."""
    cell = F.pmod(F.xxhash64(*strata), F.lit(CELLS))
    cells = df.groupBy(cell.alias("_cell")).agg(F.count("*").alias("_n")).filter(F.col("_n") > IN_MEMORY).select("_cell")
    counts = df.join(F.broadcast(cells), cell == F.col("_cell"), "left_semi").groupBy(*[F.col(c).alias(f"_of_{c}") for c in strata]).agg(F.count("*").alias("_n"))
    bits = F.least(F.ceil(F.log2(F.col("_n") * BUCKETS / IN_MEMORY)), F.lit(31))
    return stored(counts.filter(F.col("_n") > IN_MEMORY).select("*", F.monotonically_increasing_id().alias("_g"), F.pow(F.lit(2.0), 32 - bits).cast("long").alias("_width")), "large-strata")


def _permutations(held: DataFrame, seeds: Sequence[Column | str], key: str, own: Sequence[str], sides: Sequence[Column]) -> DataFrame:
    """held, a row a stratum or chunk with its rows in order (_a) and, in sides, their donors in order, as a row a pair and seed."""
    out = held.withColumn("_b", F.array(*sides)).select("*", F.posexplode("_b").alias("_rep", "_c"))
    kept = [c for c in held.columns if not c.startswith(("_a", "_b"))]
    pairs = out.select(*kept, "_rep", F.inline(F.arrays_zip("_a", "_c")))
    return pairs.select(*kept, "_rep", F.col("_a._k").alias(key), *[F.col(f"_a.{c}") for c in own], F.col("_c._k").alias("donor"), F.col("_c._given").alias("_given"))


def _in_tasks(df: DataFrame, key: str, seeds: Sequence[Column | str], strata: Sequence[str], own: Sequence[str], given: Sequence[str]) -> DataFrame:
    """permuted_rows of strata of which a task can hold any."""
    taken = df.select(*dict.fromkeys([*strata, *own, *given, key]))
    names = list(dict.fromkeys([*strata, key]))
    rows = unpack(pack(taken, names).repartition(*strata), taken, [key])
    k = F.col(key)
    a = F.struct(_place("order", k).alias("_o"), k.alias("_k"), *own)
    b = [F.struct(_place(s, k).alias("_o"), k.alias("_k"), F.struct(*(given or [F.lit(None).alias("none")])).alias("_given")) for s in seeds]
    held = rows.groupBy(*strata).agg(F.sort_array(F.collect_list(a)).alias("_a"), *[F.sort_array(F.collect_list(x)).alias(f"_b{i}") for i, x in enumerate(b)])
    held = unpack(held.withColumn("_n", F.size("_a").cast("long")), taken, list(strata))
    return _permutations(held, seeds, key, own, [F.col(f"_b{i}") for i in range(len(b))])


def _in_chunks(tagged: DataFrame, large: DataFrame, key: str, seeds: Sequence[Column | str], strata: Sequence[str], own: Sequence[str], given: Sequence[str]) -> DataFrame:
    """permuted_rows of the strata of large; tagged: the rows with _g and _width of theirs. Side 0 of a row is its rank, the others are
    its ranks as a donor. Chunks end where buckets of side 0 do."""
    sides = ["order", *seeds]
    every = F.posexplode(F.array(*[F.floor(draw(s, F.col(key)) / F.col("_width")) for s in sides])).alias("_side", "_bucket")
    counts = tagged.select("_g", every).groupBy("_g", "_side", "_bucket").agg(F.count("*").alias("_m"))
    counts = counts.withColumn("_base", F.sum("_m").over(Window.partitionBy("_g", "_side").orderBy("_bucket")) - F.col("_m"))
    first = F.col("_side") == 0
    ends = F.explode(F.when(first, F.array("_base")).otherwise(F.array(F.col("_base"), F.col("_base") + F.col("_m") - 1))).alias("_x")
    marks = counts.select("*", ends).withColumn("_own", F.when(first, F.floor(F.col("_base") / IN_MEMORY)))
    along = Window.partitionBy("_g").orderBy("_x", "_side").rowsBetween(Window.unboundedPreceding, 0)  # a row a bucket and end
    marks = marks.withColumn("_chunk", F.last("_own", ignorenulls=True).over(along))
    places = marks.groupBy("_g", "_side", "_bucket").agg(F.min("_base").alias("_base"), F.sequence(F.min("_chunk"), F.max("_chunk")).cast("array<int>").alias("_chunks"))
    places = stored(places, "chunks")
    starts = places.select("_g", "_side", "_base", F.explode("_chunks").alias("_chunk")).groupBy("_g", "_chunk")
    starts = starts.agg(*[F.min(F.when(F.col("_side") == i, F.col("_base"))).alias(f"_start{i}") for i in range(len(sides))])

    taken = tagged.select(*dict.fromkeys([*own, *given, key]))
    rows = tagged.select(*taken.columns, "_g", every).join(F.broadcast(places), ["_g", "_side", "_bucket"])
    by_row = any(isinstance(s, Column) for s in seeds)  # a donor needs its seed
    of = lambda c: F.col(c) if c == key or by_row or (c in own and c in given) else F.when(first if c in own else ~first, F.col(c))
    moved = rows.select("_g", F.explode("_chunks").alias("_chunk"), F.col("_side").cast("byte").alias("_side"), *[of(c).alias(c) for c in taken.columns])
    moved = unpack(pack(moved, [key]).repartition("_g", "_chunk"), taken, [key])
    k = F.col(key)
    a = F.when(first, F.struct(_place("order", k).alias("_o"), k.alias("_k"), *own))
    b = [F.when(F.col("_side") == i, F.struct(_place(s, k).alias("_o"), k.alias("_k"), F.struct(*(given or [F.lit(None).alias("none")])).alias("_given"))) for i, s in enumerate(seeds, 1)]
    held = moved.groupBy("_g", "_chunk").agg(F.sort_array(F.collect_list(a)).alias("_a"), *[F.sort_array(F.collect_list(x)).alias(f"_b{i}") for i, x in enumerate(b, 1)])
    held = held.join(F.broadcast(starts), ["_g", "_chunk"]).join(F.broadcast(large.drop("_width").withColumnsRenamed({f"_of_{c}": c for c in strata})), "_g")
    cut = [F.slice(f"_b{i}", (F.col("_start0") - F.col(f"_start{i}") + 1).cast("int"), F.size("_a")) for i in range(1, len(sides))]
    return _permutations(held, seeds, key, own, cut)


def donor_summary(found: DataFrame, key: str, by: Sequence[str] = ()) -> DataFrame:
    """by, n, moved_fraction (rows whose donor is another row) and, with levels, fallback_fraction (rows alone in their fine
    stratum)."""
    moved = [F.avg((F.col(key) != F.col("donor")).cast("double")).alias("moved_fraction")]
    if "level" in found.columns:
        moved.append(F.avg((F.col("level") != "fine").cast("double")).alias("fallback_fraction"))
    return found.groupBy(*by).agg(F.count("*").alias("n"), *moved)


def stratified_donors(df: DataFrame, key: str, seed: Column | str, fine: Sequence[str], coarse: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """by, key, donor, level: donors within the fine strata; rows alone there are permuted within the coarse ones, among themselves;
    rows alone there too stay (level 'none')."""
    carried = ["_seed"] if isinstance(seed, Column) else []
    rows = df.select(*dict.fromkeys([*by, *fine, *coarse]), key, *([seed.alias("_seed")] if carried else []))
    out = stratified_rows(rows, key, [F.col("_seed") if carried else seed], fine, coarse, by, carried)
    return out.select(*by, key, "donor", "level")


def stratified_rows(
    df: DataFrame, key: str, seeds: Sequence[Column | str], fine: Sequence[str], coarse: Sequence[str], by: Sequence[str] = (), own: Sequence[str] = (), given: Sequence[str] = (), keys: bool = True
) -> DataFrame:
    """by, own, key, donor, _given, _rep, level: as permuted_rows within the fine strata and, for rows alone there, among themselves within
    the coarse ones. Without keys, key and donor are null where the level is 'fine'.

    What the fine strata give is written once, packed; the rows alone in it are read several times."""
    fine, coarse = [*by, *fine], [*by, *coarse]
    held = list(dict.fromkeys([*coarse, *own]))  # of a row alone
    first = permuted_rows(df, key, seeds, fine, [c for c in held if c not in fine], given)
    alone = F.col("_n") == 1
    some = lambda c, when: F.when(when, F.col(c)).alias(c)
    names = [c for c in held if c not in by and c not in own]
    kept = first.select(*by, *own, *[some(c, alone) for c in names], some(key, alone | F.lit(keys)), some("donor", ~alone & F.lit(keys)), "_given", "_rep", alone.alias("_alone"))
    once = unpack(stored(pack(kept, [key, "donor"]), "fine-donors"), kept, [key, "donor"])
    columns = [*by, *own, key, "donor", "_given", "_rep"]
    many = once.filter("not _alone").select(*columns, F.lit("fine").alias("level"))
    # Given columns that aren't kept as own ones are those of the row itself.
    rest = once.filter("_alone and _rep = 0").select(*held, key, *[F.col(f"_given.{c}") for c in given if c not in held])
    second = permuted_rows(rest, key, seeds, coarse, [c for c in own if c not in coarse], given)
    level = F.when(F.col("_n") > 1, "coarse").otherwise("none")
    return many.union(second.select(*columns, level.alias("level")))


def donor_table(df: DataFrame, key: str, seed: str, repeats: int, by: Sequence[str] = (), strata: Mapping[str, tuple[Sequence[str], Sequence[str]]] | None = None) -> DataFrame:
    """mode, anchor, rep, by, key, donor: the donors of all modes and repeats from one permutation of (key, mode, anchor, repeat).

    Mode 'marginal' permutes within by. strata names fine and coarse strata for each anchor ('': none): mode 'stratified' permutes
    within these. Mode 'none', repeat 0, gives each row to itself.
    """
    text = lambda cs: F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in cs]) if cs else F.lit("")
    way = lambda mode, anchor, fine, coarse: F.struct(F.lit(mode).alias("mode"), F.lit(anchor).alias("anchor"), text(fine).alias("_fine"), text(coarse).alias("_coarse"))
    ways = [way("marginal", "", (), ()), *[way("stratified", a, fine, coarse) for a, (fine, coarse) in (strata or {}).items()]]
    rows = df.select(*by, key, F.explode(F.array(*ways)).alias("_w")).select(*by, key, "_w.*")
    rows = rows.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(repeats)))).withColumn("_seed", F.concat(F.lit(seed), F.col("rep").cast("string")))
    rows = stored(rows, "donor-keys")  # counted and ranked several times
    found = stratified_donors(rows, key, F.col("_seed"), ["_fine"], ["_coarse"], by=[*by, "rep", "mode", "anchor"])
    columns = ["mode", "anchor", "rep", *by, key, "donor"]
    own = df.select(*by, key).withColumns({"mode": F.lit("none"), "anchor": F.lit(""), "rep": F.lit(0), "donor": F.col(key)})
    return found.select(*columns).union(own.select(*columns))


def permuted_pairs(
    df: DataFrame, key: str, seed: str, repeats: int, given: Sequence[str], by: Sequence[str] = (), strata: Mapping[str, tuple[Sequence[str], Sequence[str]]] | None = None
) -> DataFrame:
    """mode, anchor, rep, the columns of df but strata and key, and _given: the columns given of the row's donor, for each row of
    donor_table(df, key, seed, repeats, by, strata) but those of mode 'none'.

    Values are permuted as they are: no table of donors is written or joined by key. As a join by key would, a key of several rows
    gives each with each of its donor's."""
    seeds = [f"{seed}{i}" for i in range(1, repeats + 1)]
    levels = {c for fine, coarse in (strata or {}).values() for c in (*fine, *coarse)}
    own = [c for c in df.columns if c not in levels and c not in by and c != key]
    often = stored(large_groups(df, [*by, key], 1), "repeated-keys")
    repeated = not often.isEmpty()
    columns = ["mode", "anchor", "rep", *by, *own, "_given", *([key, "donor"] if repeated else [])]
    number = (F.col("_rep") + 1).alias("rep")
    marginal = permuted_rows(df, key, seeds, by, own, given) if by else permuted_rows(df.withColumn("_all", F.lit(0)), key, seeds, ["_all"], own, given)
    out = marginal.select("*", F.lit("marginal").alias("mode"), F.lit("").alias("anchor"), number).select(columns)
    for anchor, (fine, coarse) in (strata or {}).items():
        rows = stratified_rows(df, key, seeds, fine, coarse, by, own, given, keys=repeated)
        out = out.union(rows.select("*", F.lit("stratified").alias("mode"), F.lit(anchor).alias("anchor"), number).select(columns))
    if not repeated:
        return out
    several = df.join(often, F.xxhash64(*by, key) == F.col("_h"), "left_semi").groupBy(*[F.col(b).alias(f"_of_{b}") for b in by], F.col(key).alias("_of_key"))
    several = stored(several.agg(F.collect_list(F.struct(*dict.fromkeys([*own, *given]))).alias("_rows")), "repeated-rows")
    of = lambda c: reduce(lambda a, b: a & b, [F.col(b).eqNullSafe(F.col(f"_of_{b}")) for b in by], F.col(c) == F.col("_of_key"))
    drop = [*[f"_of_{b}" for b in by], "_of_key", "_rows"]
    mine = F.transform("_rows", lambda r: F.struct(*[r[c].alias(c) for c in own])) if own else None
    if own:
        out = out.join(several, of(key), "left").withColumn("_own", F.explode(F.coalesce(mine, F.array(F.struct(*own))))).drop(*drop)
        out = out.select("mode", "anchor", "rep", *by, "_own.*", "_given", "donor")
    theirs = F.transform("_rows", lambda r: F.struct(*[r[c].alias(c) for c in given]))
    out = out.join(several, of("donor"), "left").withColumn("_given", F.explode(F.coalesce(theirs, F.array("_given")))).drop(*drop)
    return out.select([c for c in columns if c not in (key, "donor")])


#: Features whose last value tells strata of the air's moisture or warmth apart, the first that is at hand (fixed values).
ANCHORS = ("Q_1000", "RH2M", "RH_925", "DP_1000", "T2M")


def anchor_of(members: Sequence[str], held: Sequence[str]) -> str | None:
    """The anchor of the strata in which a group of features is permuted: the first that is held and isn't one of them."""
    taken, there = {m.upper() for m in members}, {h.upper() for h in held}
    return next((a for a in ANCHORS if a in there and a not in taken), None)


def with_strata(df: DataFrame, time: str, anchors: Mapping[str, Column], by: Sequence[str] = ("source",), lat: str = "lat", lon: str = "lon") -> DataFrame:
    """df with season (0 from December), hour_bin (of 6 hours), lat_bin and lon_bin (of 10 degrees), and code_<anchor>: the quartile
    of each anchor's value within by. A missing month counts as January, missing hours and coordinates as 0."""
    number = lambda c, none: F.coalesce(c, F.lit(none))
    out = df.withColumns({
        "season": F.floor((number(F.month(time), 1) % 12) / 3).cast("int"), "hour_bin": F.floor(number(F.hour(time), 0) / 6).cast("int"),
        "lat_bin": F.floor(number(F.col(lat), 0) / 10).cast("int"), "lon_bin": F.floor(number(F.col(lon), 0) / 10).cast("int"),
    } | {f"_anchor_{a}": x for a, x in anchors.items()})
    for a in anchors:
        out = quantile_code(out, f"_anchor_{a}", out=f"code_{a}", by=by)
    return out.drop(*[f"_anchor_{a}" for a in anchors])


def strata_of(anchor: str | None) -> tuple[list[str], list[str]]:
    """The fine and coarse strata of with_strata for an anchor."""
    code = [f"code_{anchor}"] if anchor else []
    return ["season", "hour_bin", "lat_bin", "lon_bin", *code], ["season", "hour_bin", *code]


def quantile_code(df: DataFrame, column: str, bins: int = 4, out: str = "code", by: Sequence[str] = ()) -> DataFrame:
    """The number of inner edges under a value, of the distinct quantiles of the column within by; -1 for null, under 4 values, or
    two edges or fewer."""
    points = [i / bins for i in range(bins + 1)]
    edges = exact_quantiles(df, by, {"v": F.col(column)}, {f"e{i}": ("v", p) for i, p in enumerate(points)})
    edges = edges.select(*[F.col(b).alias(f"_of_{b}") for b in by], F.array_distinct(F.array(*[F.col(f"e{i}") for i in range(len(points))])).alias("_e"))
    stats = df.groupBy(*[F.col(b).alias(f"_in_{b}") for b in by]).agg(F.count(column).alias("_n"))
    stats = stats.join(F.broadcast(edges), [F.col(f"_in_{b}").eqNullSafe(F.col(f"_of_{b}")) for b in by]).drop(*[f"_of_{b}" for b in by]) if by else stats.crossJoin(edges)
    inner = F.slice("_e", 2, F.greatest(F.size("_e") - 2, F.lit(0)))
    code = F.size(F.filter(inner, lambda e: e < F.col(column)))
    ok = F.col(column).isNotNull() & (F.col("_n") >= 4) & (F.size("_e") > 2)
    # One row of stats, or a row a group.
    joined = df.join(F.broadcast(stats), [F.col(b).eqNullSafe(F.col(f"_in_{b}")) for b in by]) if by else df.crossJoin(F.broadcast(stats))
    return joined.withColumn(out, F.when(ok, code).otherwise(-1)).drop("_e", "_n", *[f"_in_{b}" for b in by])
