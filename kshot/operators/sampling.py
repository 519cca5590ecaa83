"""Pair, episode and one-shot task sampling.

Every draw is a keyed hash (P1) of the draw's coordinates, turned into a member index of a class
(P3) or a global item position, and resolved by an equi-join.  Work is O(items + draws): no rand(),
no items x items, and a class holding a third of all items is spread over its members.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kshot.functions.draw import distinct_indices, distinct_indices_array, keyed_index, shift_past
from kshot.operators.joins import small_join
from kshot.operators.labels import MAX_ROWS
from kshot.operators.positions import class_offsets, member_index, ranged_position
from kshot.session import staged

#: Class tables up to this size are broadcast; larger ones meet the draws on (class, salt).
MAX_CLASSES = 200_000


def _seq(n: int | Column) -> Column:
    n = n if isinstance(n, Column) else F.lit(n)
    return F.explode(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")))


def _lookup(draws: DataFrame, members: DataFrame, keys: dict[str, str], out: str) -> DataFrame:
    """Resolve one draw to an item id: ``members(..., item_id)`` joined on ``keys`` (member col -> draw col)."""
    m = members.select(*[F.col(k).alias(v) for k, v in keys.items()], F.col("item_id").alias(out))
    return draws.join(m, list(keys.values()))


def _resolve(draws: DataFrame, keep: list[str], specs: list[tuple[str, list[str]]], table: DataFrame,
             on: list[str]) -> DataFrame:
    """Resolve several draws per row with ONE join: every draw becomes a lookup row ``(keep, slot, on...)``,
    the lookups meet ``table(on..., item_id)`` once and are pivoted back per draw row by ``keep``.

    ``specs`` is ``[(out_col, [draw cols matching on])]``; ``keep`` must identify a draw row.
    """
    ks = [f"_k{i}" for i in range(len(on))]
    lk = F.explode(F.array(*[F.struct(F.lit(i).alias("_slot"), *[F.col(c).alias(k) for c, k in zip(cols, ks)])
                             for i, (_, cols) in enumerate(specs)])).alias("_l")
    rows = draws.select(*keep, lk).select(*keep, "_l.*")
    j = rows.join(table.select(*[F.col(o).alias(k) for o, k in zip(on, ks)], "item_id"), ks)
    return j.groupBy(*keep).agg(*[F.max(F.when(F.col("_slot") == i, F.col("item_id"))).alias(out)
                                  for i, (out, _) in enumerate(specs)])


def _members(items: DataFrame, seed, min_members: int = 1, class_col: str = "class"):
    idx = member_index(items, seed, class_col)
    members = idx.items.where(F.col("n") >= min_members)
    classes = idx.classes.where(F.col("n") >= min_members)
    return members.select(class_col, *([c for c in ("superclass",) if c in items.columns]),
                          "member_idx", "item_id", "n"), classes


def _class_table(classes: DataFrame) -> DataFrame:
    """``(class, class_idx, n)`` from ``(class, n)``, which is written once: it is counted and joined several times."""
    classes = staged(classes.select("class", "n"), "class_table")
    if classes.count() <= MAX_ROWS:
        return classes.withColumn("class_idx", (F.row_number().over(Window.orderBy("class")) - 1).cast("bigint"))
    return ranged_position(classes, [F.col("class")], "class_idx", MAX_ROWS).withColumn("class_idx", F.col("class_idx") - 1)


# ---------------------------------------------------------------------------------------- D1
def _rounds(classes: DataFrame, m: int, max_broadcast_rows: int = 1_000_000) -> DataFrame:
    """``classes x round`` draw coordinates, generated from a distributed ``range(m)`` so the draw
    work is spread over tasks (the class table itself comes out of a single ordered window).  The
    class table is broadcast only under a checked row bound; above it, it is spread first."""
    spark = classes.sparkSession
    rounds = spark.range(m).select(F.col("id").cast("int").alias("round"))
    if classes.limit(max_broadcast_rows + 1).count() <= max_broadcast_rows:
        return rounds.join(F.broadcast(classes), how="cross")
    spread = classes.repartition(spark.sparkContext.defaultParallelism)
    return spread.withColumn("round", _seq(m))


def sample_balanced_pairs(items: DataFrame, m: int, seed, min_members: int = 3, neg_samples: int = 1) -> DataFrame:
    """Per class and round, (s0, s1, 1) and ``neg_samples`` pairs (s2, neg, 0); s0..s2 distinct members of the
    class, every neg uniform over all items of all other classes.  Classes with < 3 members draw no rounds.

    Output ``(class, round, pair_no, a, b, label)``; pair 0 is the positive one.
    """
    idx = member_index(items, seed)
    offs = class_offsets(idx.classes)                          # class, n, off
    total = idx.classes.agg(F.sum("n").alias("n_all"))
    gitems = (small_join(idx.items.select("class", "member_idx", "item_id"), offs.select("class", "off"), "class", "item_id")
              .select((F.col("off") + F.col("member_idx")).alias("gpos"), "item_id"))
    d = _rounds(offs.where(F.col("n") >= min_members).crossJoin(total), m)
    s0, s1, s2 = distinct_indices(F.col("n"), 3, seed, F.col("class"), F.col("round"))

    def negative(j: int) -> Column:
        g = keyed_index(F.col("n_all") - F.col("n"), seed, F.col("class"), F.col("round"), f"neg{j}" if j else "neg")
        return shift_past(g, F.col("off"), F.col("n"))
    d = d.select("class", "round", *[(F.col("off") + s).alias(f"p{i}") for i, s in enumerate((s0, s1, s2))],
                 *[negative(j).alias(f"p{3 + j}") for j in range(neg_samples)])
    d = _resolve(d, ["class", "round"], [(f"i{i}", [f"p{i}"]) for i in range(3 + neg_samples)], gitems, ["gpos"])
    pairs = [F.struct(F.lit(0).alias("pair_no"), F.col("i0").alias("a"), F.col("i1").alias("b"), F.lit(1).alias("label")),
             *[F.struct(F.lit(1 + j).alias("pair_no"), F.col("i2").alias("a"), F.col(f"i{3 + j}").alias("b"),
                        F.lit(0).alias("label")) for j in range(neg_samples)]]
    return d.select("class", "round", F.inline(F.array(*pairs)))


# ---------------------------------------------------------------------------------------- D2, D3
def _scoped_classes(classes: DataFrame, min_classes: int = 1) -> DataFrame:
    """``(superclass, class, n, cidx, cs, sidx, n_super)`` over the class table (C rows): class index
    in name order inside its superclass, superclass index in name order among superclasses that keep
    at least ``min_classes`` classes."""
    by_sup = Window.partitionBy("superclass")
    cls = (classes.withColumn("cidx", (F.row_number().over(by_sup.orderBy("class")) - 1).cast("bigint"))
           .withColumn("cs", F.count(F.lit(1)).over(by_sup))
           .where(F.col("cs") >= min_classes))
    return (cls.withColumn("sidx", (F.dense_rank().over(Window.orderBy("superclass")) - 1).cast("bigint"))
            .withColumn("n_super", F.max("sidx").over(Window.partitionBy()) + 1))


def sample_train_batch_scoped(items: DataFrame, batch: int, steps: int, seed, start_step: int = 0,
                              max_broadcast_rows: int = MAX_CLASSES) -> DataFrame:
    """Step s uses superclass ``s mod S`` (name order); ``batch`` class draws with replacement inside
    it; per draw 3 distinct members and a negative from another class of the same superclass (uniform
    over classes, then members).  2 * batch pairs per step.

    Output ``(step, draw, pair_no, superclass, a, b, label)``.
    """
    members, classes = _members(items, seed, 3)
    sc = items.select("superclass", "class").distinct().join(classes, "class")
    cinfo = staged(_scoped_classes(sc, 2), "class_table")
    sup = cinfo.select("superclass", "sidx", "cs").distinct()
    spark = items.sparkSession
    n_super = cinfo.agg(F.max("n_super")).first()[0] or 1
    # draws first: what follows is spread over them, also where one superclass holds all classes
    st = (spark.range(start_step, start_step + steps).select(F.col("id").alias("step")).withColumn("draw", _seq(batch))
          .withColumn("sidx", F.col("step") % n_super))
    st = small_join(st, sup, "sidx", ["step", "draw"], max_broadcast_rows)
    st = st.withColumn("cidx", keyed_index(F.col("cs"), seed, F.col("step"), F.col("draw"), "c"))
    st = small_join(st, cinfo.select("superclass", "cidx", "class", "n"), ["superclass", "cidx"], ["step", "draw"],
                    max_broadcast_rows)
    s0, s1, s2 = distinct_indices(F.col("n"), 3, seed, F.col("step"), F.col("draw"))
    oc = shift_past(keyed_index(F.col("cs") - 1, seed, F.col("step"), F.col("draw"), "o"), F.col("cidx"), F.lit(1))
    st = st.select("step", "draw", "superclass", "class", s0.alias("m0"), s1.alias("m1"), s2.alias("m2"),
                   oc.alias("ocidx"))
    other = cinfo.select("superclass", F.col("cidx").alias("ocidx"), F.col("class").alias("oclass"),
                         F.col("n").alias("on"))
    st = small_join(st, other, ["superclass", "ocidx"], ["step", "draw"], max_broadcast_rows)
    st = st.withColumn("m3", keyed_index(F.col("on"), seed, F.col("step"), F.col("draw"), "m"))
    mem = members.select("class", "member_idx", "item_id")
    st = _resolve(st, ["step", "draw", "superclass"],
                  [("i0", ["class", "m0"]), ("i1", ["class", "m1"]), ("i2", ["class", "m2"]), ("i3", ["oclass", "m3"])],
                  mem, ["class", "member_idx"])
    pos = st.select("step", "draw", F.lit(0).alias("pair_no"), "superclass", F.col("i0").alias("a"),
                    F.col("i1").alias("b"), F.lit(1).alias("label"))
    neg = st.select("step", "draw", F.lit(1).alias("pair_no"), "superclass", F.col("i2").alias("a"),
                    F.col("i3").alias("b"), F.lit(0).alias("label"))
    return pos.unionByName(neg)


def sample_train_batch(items: DataFrame, batch: int, steps: int, seed, start_step: int = 0,
                       max_broadcast_rows: int = MAX_CLASSES) -> DataFrame:
    """D3: D2 without the superclass level (one scope over all given classes)."""
    flat = items.withColumn("superclass", F.lit("*"))
    return sample_train_batch_scoped(flat, batch, steps, seed, start_step, max_broadcast_rows).drop("superclass")


# ---------------------------------------------------------------------------------------- D4-D7
def sample_episodes(items: DataFrame, episodes: int, n_way: int, k_shot: int, seed,
                    replace: bool = True, max_broadcast_rows: int = MAX_CLASSES) -> DataFrame:
    """Per episode ``n_way`` classes and ``k_shot`` members per class, with replacement by default.

    Output ``(episode, slot, way, shot, class, member_idx, item_id)``; slot = way * k_shot + shot.
    """
    members, classes = _members(items, seed, 1 if replace else k_shot)
    cinfo = _class_table(classes)
    spark = items.sparkSession
    ep = spark.range(episodes).select(F.col("id").alias("episode"), F.lit(cinfo.count()).alias("C"))
    if replace:
        ep = ep.withColumn("way", _seq(n_way)).withColumn(
            "class_idx", keyed_index(F.col("C"), seed, F.col("episode"), F.col("way"), "c"))
    else:
        picks = distinct_indices_array(F.col("C"), n_way, seed, F.col("episode"), "c")
        ep = ep.select("episode", F.posexplode(picks).alias("way", "class_idx"))
    ep = small_join(ep, cinfo, "class_idx", ["episode", "way"], max_broadcast_rows)
    if replace:
        ep = ep.withColumn("shot", _seq(k_shot)).withColumn(
            "member_idx", keyed_index(F.col("n"), seed, F.col("episode"), F.col("way"), F.col("shot"), "s"))
    else:
        picks = distinct_indices_array(F.col("n"), k_shot, seed, F.col("episode"), F.col("way"), "s")
        ep = ep.select("episode", "way", "class", F.posexplode(picks).alias("shot", "member_idx"))
    ep = ep.join(members.select("class", "member_idx", "item_id"), ["class", "member_idx"])
    return ep.select("episode", (F.col("way") * k_shot + F.col("shot")).alias("slot"), "way", "shot", "class",
                     "member_idx", "item_id")


def episode_pairs(episodes: DataFrame, pairs: int, seed, slots: int) -> DataFrame:
    """``pairs`` ordered slot pairs per episode, with replacement; label = same class.

    Output ``(episode, pair_no, a, b, label)``.
    """
    # few rows of many draws each: dealt over the cores, however little the rows weigh
    cores = episodes.sparkSession.sparkContext.defaultParallelism
    ep = episodes.select("episode").distinct().repartition(cores, "episode").withColumn("pair_no", _seq(pairs))
    ep = ep.select("episode", "pair_no",
                   keyed_index(slots, seed, F.col("episode"), F.col("pair_no"), "a").alias("sa"),
                   keyed_index(slots, seed, F.col("episode"), F.col("pair_no"), "b").alias("sb"))
    tbl = episodes.select("episode", "slot", "item_id", "class")
    lk = F.explode(F.array(F.struct(F.lit(0).alias("_s"), F.col("sa").alias("slot")),
                           F.struct(F.lit(1).alias("_s"), F.col("sb").alias("slot")))).alias("_l")
    j = ep.select("episode", "pair_no", lk).select("episode", "pair_no", "_l.*").join(tbl, ["episode", "slot"])
    out = j.groupBy("episode", "pair_no").agg(
        F.max(F.when(F.col("_s") == 0, F.col("item_id"))).alias("a"),
        F.max(F.when(F.col("_s") == 1, F.col("item_id"))).alias("b"),
        F.max(F.when(F.col("_s") == 0, F.col("class"))).alias("ca"),
        F.max(F.when(F.col("_s") == 1, F.col("class"))).alias("cb"))
    return out.select("episode", "pair_no", "a", "b", (F.col("ca") == F.col("cb")).cast("int").alias("label"))


def episode_remainder(episodes: DataFrame, items: DataFrame, seed, chunk: int = 4096) -> DataFrame:
    """For each (episode, way) the members of its class not drawn as that way's shots.

    Output ``(episode, way, class, member_idx, item_id)``; its size is the sum of the drawn class
    sizes.  Members are cut into chunks of ``chunk`` consecutive member indices and each way row is
    replicated per chunk of its class, so the join key is ``(class, chunk)``: a hot class drawn in many
    episodes is spread over many tasks instead of one.
    """
    members, classes = _members(items, seed)
    ways = (episodes.select("episode", "way", "class").distinct().join(classes, "class")
            .withColumn("_chunk", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / chunk).cast("int"))))
            .drop("n"))
    mem = members.select("class", "member_idx", "item_id",
                         F.floor(F.col("member_idx") / chunk).cast("int").alias("_chunk"))
    cand = ways.join(mem, ["class", "_chunk"]).drop("_chunk")
    shots = episodes.select("episode", "way", "member_idx")
    return cand.join(shots, ["episode", "way", "member_idx"], "left_anti").select(
        "episode", "way", "class", "member_idx", "item_id")


def episode_query_pairs(episodes: DataFrame, items: DataFrame, seed, max_broadcast_rows: int = MAX_CLASSES) -> DataFrame:
    """Per episode one query drawn uniformly from the remainder (D7) of all its ways, paired with
    every support row.  Computed without materialising the remainder: the draw picks a way by running
    remainder sizes, then the j-th unpicked member index.

    Output ``(episode, slot, support, query, label)``.
    """
    members, classes = _members(items, seed)
    drawn = episodes.groupBy("episode", "way", "class").agg(
        F.array_sort(F.array_distinct(F.collect_list("member_idx"))).alias("shots"))
    per_way = small_join(drawn, staged(classes, "class_table"), "class", ["episode", "way"], max_broadcast_rows).withColumn(
        "rem", F.col("n") - F.size("shots"))
    w = Window.partitionBy("episode").orderBy("way")
    per_way = (per_way.withColumn("cum", F.coalesce(F.sum("rem").over(w.rowsBetween(Window.unboundedPreceding, -1)),
                                                    F.lit(0)))
               .withColumn("total", F.sum("rem").over(Window.partitionBy("episode"))))
    g = keyed_index(F.col("total"), seed, F.col("episode"), "q")
    pick = (per_way.withColumn("g", g)
            .where((F.col("g") >= F.col("cum")) & (F.col("g") < F.col("cum") + F.col("rem"))))
    j = F.col("g") - F.col("cum")
    pick = pick.select("episode", "class", F.aggregate("shots", j, lambda acc, p: acc + F.when(acc >= p, 1)
                                                       .otherwise(0)).alias("member_idx"))
    q = pick.join(members.select("class", "member_idx", "item_id"), ["class", "member_idx"]).select(
        "episode", F.col("item_id").alias("query"), F.col("class").alias("qclass"))
    out = episodes.join(q, "episode")
    return out.select("episode", "slot", F.col("item_id").alias("support"), "query",
                      (F.col("class") == F.col("qclass")).cast("int").alias("label"))


# ---------------------------------------------------------------------------------------- D8-D10
def one_shot_tasks_scoped(items: DataFrame, n: int, tasks: int, seed, max_broadcast_rows: int = MAX_CLASSES) -> DataFrame:
    """Per superclass and task: a class, two distinct members (query, positive) and n-1 distinct
    other classes of the superclass with one member each; n is capped at the class count, -1 = all.

    Output ``(superclass, task, pair_no, query, support, label)``; pair 0 is the positive.
    """
    members, classes = _members(items, seed, 2)
    sc = items.select("superclass", "class").distinct().join(classes, "class")
    cinfo = staged(_scoped_classes(sc).select("superclass", "cidx", "class", "n", "cs"), "class_table")
    by_idx = cinfo.select("superclass", "cidx", "class", "n")
    t = _rounds(cinfo.where("cidx = 0").select("superclass", "cs"), tasks, max_broadcast_rows)
    t = (t.select("superclass", "cs", F.col("round").cast("bigint").alias("task"))
         .withColumn("cidx", keyed_index(F.col("cs"), seed, F.col("superclass"), F.col("task"), "c")))
    t = small_join(t, by_idx, ["superclass", "cidx"], "task", max_broadcast_rows)
    q0, q1 = distinct_indices(F.col("n"), 2, seed, F.col("superclass"), F.col("task"))
    nneg = (F.col("cs") if n == -1 else F.least(F.lit(n), F.col("cs"))) - 1
    t = t.select("superclass", "task", "class", "cidx", "cs", q0.alias("mq"), q1.alias("mp"), nneg.alias("nneg"))
    mem = members.select("class", "member_idx", "item_id")
    t = _resolve(t, ["superclass", "task", "class", "cidx", "cs", "nneg"],
                 [("query", ["class", "mq"]), ("positive", ["class", "mp"])], mem, ["class", "member_idx"])
    if n == -1:
        # every other class of the superclass is a negative: tasks x classes rows, each found by its class index
        negs = (t.select("superclass", "task", F.col("cidx").alias("qidx"), "nneg", "query",
                         F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("cs") - 1)).alias("cidx"))
                .where(F.col("cidx") != F.col("qidx")))
        negs = small_join(negs, by_idx, ["superclass", "cidx"], "task", max_broadcast_rows)
        rk = Window.partitionBy("superclass", "task").orderBy(
            F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("superclass"), F.col("task").cast("string"),
                              F.col("class").cast("string"))), "class")
        negs = negs.withColumn("pair_no", F.row_number().over(rk))
    else:
        # n-1 distinct other classes drawn row-locally (P4), then resolved by an equi-join
        picks = distinct_indices_array(F.col("cs") - 1, n - 1, seed, F.col("superclass"), F.col("task"), "neg")
        negs = (t.select("superclass", "task", "cidx", "nneg", "query", F.posexplode(picks).alias("j", "o"))
                .where(F.col("j") < F.col("nneg"))
                .select("superclass", "task", "nneg", "query", (F.col("j") + 1).alias("pair_no"),
                        shift_past(F.col("o"), F.col("cidx"), F.lit(1)).alias("cidx")))
        negs = small_join(negs, by_idx, ["superclass", "cidx"], "task", max_broadcast_rows)
    negs = (negs.where(F.col("pair_no") <= F.col("nneg"))
            .withColumn("member_idx", keyed_index(F.col("n"), seed, F.col("superclass"), F.col("task"),
                                                  F.col("class"), "m")))
    negs = negs.join(mem, ["class", "member_idx"]).select(
        "superclass", "task", F.col("pair_no").cast("int").alias("pair_no"), "query",
        F.col("item_id").alias("support"), F.lit(0).alias("label"))
    pos = t.select("superclass", "task", F.lit(0).alias("pair_no"), "query", F.col("positive").alias("support"),
                   F.lit(1).alias("label"))
    return pos.unionByName(negs)


def one_shot_tasks(items: DataFrame, n: int, tasks: int, seed, max_broadcast_rows: int = MAX_CLASSES) -> DataFrame:
    """Global tasks; the n-1 negative classes are drawn with replacement among the other classes
    (-1 = as many as there are classes).

    Output ``(task, pair_no, query, support, label)``.
    """
    members, classes = _members(items, seed, 2)
    cinfo = _class_table(classes)
    spark = items.sparkSession
    t = (spark.range(tasks).select(F.col("id").alias("task"), F.lit(cinfo.count()).alias("C"))
         .withColumn("class_idx", keyed_index(F.col("C"), seed, F.col("task"), "c")))
    t = small_join(t, cinfo, "class_idx", "task", max_broadcast_rows)
    q0, q1 = distinct_indices(F.col("n"), 2, seed, F.col("task"))
    t = t.select("task", "class", "class_idx", "C", q0.alias("mq"), q1.alias("mp"))
    mem = members.select("class", "member_idx", "item_id")
    t = _resolve(t, ["task", "class", "class_idx", "C"], [("query", ["class", "mq"]), ("positive", ["class", "mp"])],
                 mem, ["class", "member_idx"])
    nneg = (F.col("C") if n == -1 else F.lit(n)) - 1
    negs = (t.select("task", "class_idx", "C", "query", nneg.alias("nneg"))
            .withColumn("pair_no", F.explode(F.sequence(F.lit(1), F.col("nneg"))))
            .withColumn("oidx", shift_past(keyed_index(F.col("C") - 1, seed, F.col("task"), F.col("pair_no"), "o"),
                                           F.col("class_idx"), F.lit(1))))
    others = cinfo.select(F.col("class_idx").alias("oidx"), F.col("class").alias("oclass"), F.col("n").alias("on"))
    negs = (small_join(negs, others, "oidx", ["task", "pair_no"], max_broadcast_rows)
            .withColumn("om", keyed_index(F.col("on"), seed, F.col("task"), F.col("pair_no"), "m")))
    negs = _lookup(negs, mem, {"class": "oclass", "member_idx": "om"}, "support").select(
        "task", "pair_no", "query", "support", F.lit(0).alias("label"))
    pos = t.select("task", F.lit(0).alias("pair_no"), "query", F.col("positive").alias("support"),
                   F.lit(1).alias("label"))
    return pos.unionByName(negs)


def alternating_labels(pair_no: Column, one_shot: bool) -> Column:
    """Training batches alternate 1, 0, 1, 0...; one-shot tasks label only pair 0."""
    return ((pair_no == 0) if one_shot else (pair_no % 2 == 0)).cast("int")


# ---------------------------------------------------------------------------------------- D12
def sweep_sizes(sizes: list[int], slots: int, items: int) -> list[int]:
    """Episode counts of a sweep: ``sizes``, and where they draw fewer slots than there are items, one that draws as many."""
    whole = -(-items // slots)
    return [*sizes, whole] if whole > max(sizes) else list(sizes)


def scale_sweep(items: DataFrame, tokens: Column, thresholds: list[int], pairs: int, n_way: int,
                k_shot: int, seed, max_broadcast_rows: int = 1_000_000) -> DataFrame:
    """One episode/pair run at the largest episode count, summarised at every threshold E:
    ``(episodes, pairs, positives, vocab_size)`` where vocab counts distinct tokens of the items used.

    ``tokens`` is the list of an item's tokens, repeats allowed, made of columns of ``items``.  Each used item is exploded
    once: a token enters the vocabulary at the first episode that uses any item holding it.  Items meet the used ones
    before they are split into tokens: by broadcast under ``max_broadcast_rows`` narrow rows, so that nothing but tokens,
    once a task, is shuffled; above that by one join on ``item_id``, which is unique, so every text moves once.
    """
    ep = staged(sample_episodes(items, max(thresholds), n_way, k_shot, seed), "sweep_episodes")
    pr = staged(episode_pairs(ep, pairs, seed, n_way * k_shot), "sweep_pairs")
    th = F.array(*[F.lit(t) for t in thresholds])
    counts = (pr.withColumn("episodes", F.explode(F.filter(th, lambda t: F.col("episode") < t)))
              .groupBy("episodes").agg(F.count(F.lit(1)).alias("pairs"), F.sum("label").alias("positives")))
    used = (pr.select("episode", F.col("a").alias("item_id"))
            .unionByName(pr.select("episode", F.col("b").alias("item_id")))
            .groupBy("item_id").agg(F.min("episode").alias("first_ep")))
    met = small_join(items, staged(used, "sweep_items"), "item_id", "item_id", max_broadcast_rows, salts=1)
    tok_first = met.select("first_ep", F.explode(tokens).alias("token")).groupBy("token").agg(F.min("first_ep").alias("first_ep"))
    vocab = (tok_first.withColumn("episodes", F.explode(F.filter(th, lambda t: F.col("first_ep") < t)))
             .groupBy("episodes").agg(F.count(F.lit(1)).alias("vocab_size")))
    return counts.join(vocab, "episodes", "left").select(
        "episodes", "pairs", F.col("positives").cast("bigint").alias("positives"),
        F.coalesce(F.col("vocab_size"), F.lit(0)).alias("vocab_size"))


