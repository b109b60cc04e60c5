"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame operations only.

A source's target over its size says how often each of its documents is copied: a whole number of
times for all, and a fraction that is rounded for each so that the source's words stay put. Two
fractional documents pass mass (fraction times words) to each other at random, without drift,
until one of them is 0 or 1. Small groups are folded this way side by side; what each leaves
unrounded, one document at most, goes up a tree of groups whose root rounds the last one. What that
leaves a source off its target is mixed again, from its smaller documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .order import numbered
from .rows import Packed
from .store import cut

#: Documents that one node of the tree folds, on average.
FAN_IN = 32
#: No document is copied more often.
MOST_COPIES = 3
#: After rounding, a source is off its target by a part of one text, which may be a very long one. What it is off by is then rounded
#: anew over its texts of at most this share of that: who was rounded down goes up, or the other way, and others only where these don't suffice. Small ones first, larger ones where these were too few.
CORRECTIONS = (1 / 8, 1 / 2, 1 / 4)

_WORD = r"[^\x20\x09-\x0D]+"


def size_of(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """(source, source_size, target) of (source, source_size).

    Sources by code point, null last, take the weights in turn and share the sum of all sizes; a
    target stops at MOST_COPIES times its source's size and the rest is reshared by weight. Each
    round caps the sources whose share of what is left is too much for them, until a round finds no
    more; the driver sees only sums.
    """
    turns = numbered(sizes.select("source"), "turn").alias("t")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("turn") % len(weights) + 1).cast("int"))
    rows = sizes.alias("s").join(turns, F.col("s.source").eqNullSafe(F.col("t.source")))
    rows = cut(rows.select("s.source", "source_size", w.alias("w"), (F.col("source_size") * float(MOST_COPIES)).alias("cap")), "weights")
    total = rows.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    level, n_capped = 0.0, -1
    while True:
        full = F.col("cap") <= level * F.col("w")
        caps, free, n = rows.agg(F.coalesce(F.sum(F.when(full, F.col("cap"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~full, F.col("w"))), F.lit(0.0)), F.count_if(full)).first()
        if n == n_capped or not free:
            break
        level, n_capped = (total - caps) / free, n
    return rows.select("source", "source_size", F.least("cap", F.col("w") * level).alias("target") if n == n_capped else F.col("cap").alias("target"))


#: Two documents a and x. up: a gains and x loses; else the other way. The one that first reaches 0 or 1 is decided, the other keeps the mass.
_FOLD = """
aggregate(
  array_sort(collect_list(struct(rank, doc, size, n, mass, p))),
  cast(null as struct<a:struct<rank:bigint,doc:{key},size:bigint,n:bigint,mass:double,p:double>,done:array<struct<doc:{key},size:bigint,take:int>>>),
  (s, x) -> case when s.a is null then named_struct('a', x, 'done', coalesce(s.done, array())) else
    transform(array(named_struct(
      'up', least(1 - s.a.p, x.p * x.mass / s.a.mass),
      'down', least(s.a.p, (1 - x.p) * x.mass / s.a.mass),
      'u', (xxhash64(s.a.rank, s.a.doc, x.rank, x.doc, {seed}) & 9007199254740991) / 9007199254740992D)),
    m -> case
      when m.u * (m.up + m.down) < m.down then
        case when 1 - s.a.p <= x.p * x.mass / s.a.mass
          then named_struct('a', named_struct('rank', x.rank, 'doc', x.doc, 'size', x.size, 'n', x.n, 'mass', x.mass, 'p', greatest(0D, x.p - m.up * s.a.mass / x.mass)), 'done', concat(s.done, array(named_struct('doc', s.a.doc, 'size', s.a.size, 'take', 1))))
          else named_struct('a', named_struct('rank', s.a.rank, 'doc', s.a.doc, 'size', s.a.size, 'n', s.a.n, 'mass', s.a.mass, 'p', least(1D, s.a.p + m.up)), 'done', concat(s.done, array(named_struct('doc', x.doc, 'size', x.size, 'take', 0)))) end
      else
        case when s.a.p <= (1 - x.p) * x.mass / s.a.mass
          then named_struct('a', named_struct('rank', x.rank, 'doc', x.doc, 'size', x.size, 'n', x.n, 'mass', x.mass, 'p', least(1D, x.p + m.down * s.a.mass / x.mass)), 'done', concat(s.done, array(named_struct('doc', s.a.doc, 'size', s.a.size, 'take', 0))))
          else named_struct('a', named_struct('rank', s.a.rank, 'doc', s.a.doc, 'size', s.a.size, 'n', s.a.n, 'mass', s.a.mass, 'p', greatest(0D, s.a.p - m.down)), 'done', concat(s.done, array(named_struct('doc', x.doc, 'size', x.size, 'take', 1)))) end
    end)[0] end)
"""


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = (1, 2, 3), seed: int = 17) -> DataFrame:
    """(key, source, size, source_size, target, copies, taken): one row for each row of docs.

    taken is copies times size. Rows alike in key, source and size share one decision; empty and
    null texts have size 0 and take nothing. The choice depends on key, source, size and seed only,
    so reruns agree. A null source is a source; a null key is a key.
    """
    kind = dict(docs.dtypes)[key]
    sized = cut(docs.select(F.col(key).alias("doc"), F.col(source).alias("source"), size_of(F.col(text)).alias("size")), "sizes")
    stats = cut(source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"))), "targets")
    units = sized.where("size > 0").groupBy("source", "doc", "size").agg(F.count("*").alias("n"))
    copies = F.col("target") / F.col("source_size")
    of = units.alias("u").join(stats.alias("s"), F.col("u.source").eqNullSafe(F.col("s.source")))
    of = of.select("u.source", "doc", "size", "n", (F.col("size") * F.col("n")).cast("double").alias("mass"), "target", F.floor(copies).cast("long").alias("base"), copies.alias("copies"))
    decided = rounded(of.select("source", "doc", "size", "n", "mass", (F.col("copies") - F.floor("copies")).alias("p")), kind, seed)
    taken = _joined(of.withColumn("copies", F.col("base")), decided)
    for again, share in enumerate(CORRECTIONS, 1):
        taken = cut(taken, "taken")
        off = taken.groupBy("source").agg((F.first("target") - F.sum(F.col("copies") * F.col("mass"))).alias("off"))
        near = taken.alias("t").join(off.alias("o"), F.col("t.source").eqNullSafe(F.col("o.source"))).select("t.*", "off")
        up = F.col("off") > 0
        near = near.where((F.col("mass") <= F.abs("off") * share) & F.when(up, F.col("copies") < MOST_COPIES).otherwise(F.col("copies") > 0))
        near = near.withColumn("next", F.col("copies") - F.col("base") == F.when(up, 0).otherwise(1))
        room = near.groupBy("source").agg(F.sum("mass").alias("all"), F.coalesce(F.sum(F.when(F.col("next"), F.col("mass"))), F.lit(0.0)).alias("room"))
        moved = near.alias("n").join(room.alias("r"), F.col("n.source").eqNullSafe(F.col("r.source")))
        enough = F.col("room") >= F.abs("off")
        moved = moved.where(F.col("next") | ~enough).withColumn("p", F.least(F.lit(1.0), F.abs("off") / F.when(enough, F.col("room")).otherwise(F.col("all"))))
        moved = moved.select("n.source", "doc", "size", "n.n", "mass", "p")
        step = rounded(moved, kind, seed + 100 * again)
        signs = off.select("source", F.signum("off").cast("long").alias("sign"))
        step = step.alias("d").join(signs.alias("g"), F.col("d.source").eqNullSafe(F.col("g.source"))).select("d.source", "doc", "size", (F.col("take") * F.col("sign")).alias("take"))
        taken = _joined(taken, step)
    taken = cut(taken.select("source", "doc", "size", "copies"), "taken")
    out = sized.alias("d").join(stats.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")))
    same = F.col("d.source").eqNullSafe(F.col("c.source")) & F.col("d.doc").eqNullSafe(F.col("c.doc")) & (F.col("d.size") == F.col("c.size"))
    times = F.coalesce(F.col("c.copies"), F.lit(0)).cast("long")
    return out.join(taken.alias("c"), same, "left").select(F.col("d.doc").alias(key), F.col("d.source").alias("source"), F.col("d.size").alias("size"), "source_size", "target", times.alias("copies"), (times * F.col("d.size")).alias("taken"))


def _joined(units: DataFrame, decided: DataFrame) -> DataFrame:
    """units with what was decided added to their copies."""
    same = F.col("u.source").eqNullSafe(F.col("c.source")) & F.col("u.doc").eqNullSafe(F.col("c.doc")) & (F.col("u.size") == F.col("c.size"))
    more = (F.col("u.copies") + F.coalesce("take", F.lit(0))).cast("long")
    return units.alias("u").join(decided.alias("c"), same, "left").select("u.source", "u.doc", "u.size", "u.n", "u.mass", "u.target", "u.base", more.alias("copies"))


def rounded(frac: DataFrame, kind: str, seed: int) -> DataFrame:
    """(source, doc, size, take): each unit's fraction p rounded to 0 or 1 by the tree, so that a source's mass stays put but for one unit's."""
    frac = frac.where("p > 0").withColumn("rank", F.xxhash64("doc", "size", F.lit(seed)))
    groups = frac.groupBy("source").agg(F.ceil(F.count("*") / FAN_IN).alias("groups"))
    columns = [F.col(f"f.{c}") for c in ("source", "doc", "size", "n", "mass", "p", "rank")]
    level = cut(
        frac.alias("f").join(groups.alias("g"), F.col("f.source").eqNullSafe(F.col("g.source"))).select(*columns, "groups", F.pmod(F.xxhash64("rank"), "groups").alias("node")),
        "leaves",
    )
    most, depth = level.agg(F.max("groups")).first()[0] or 0, 0
    decided = None
    while most:
        folded = level.groupBy("source", "groups", "node").agg(F.expr(_FOLD.format(key=kind, seed=seed + depth)).alias("s"))
        folded = cut(folded, "folded")
        done = folded.select("source", F.inline("s.done"))
        decided = done if decided is None else decided.unionByName(done)
        if most == 1:
            last = folded.select("source", "s.a.*").withColumn("u", F.expr(f"(xxhash64(rank, doc, {seed}) & 9007199254740991) / 9007199254740992D"))
            return decided.unionByName(last.select("source", "doc", "size", (F.col("u") < F.col("p")).cast("int").alias("take")))
        level = folded.select("source", F.ceil(F.col("groups") / FAN_IN).alias("groups"), F.floor(F.col("node") / FAN_IN).alias("node"), "s.a.*")
        most, depth = -(-most // FAN_IN), depth + 1
    return frac.select("source", "doc", "size", F.lit(0).alias("take"))  # nothing to round


def copies_of(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """docs as mixed: each row as often as mix() says, numbered by copy, with size, source_size and target.

    Where docs has a column of such a name, that one stays and the new one is called mix_copy and so on.
    """
    packed = Packed(docs, doc=key, text=text, source=source)
    plan = mix(packed.df, "doc", "text", "source", **options).where("copies > 0").distinct().alias("p")
    rows = packed.df.withColumn("size", size_of(F.col("text"))).alias("d")
    same = F.col("d.doc").eqNullSafe(F.col("p.doc")) & F.col("d.source").eqNullSafe(F.col("p.source")) & (F.col("d.size") == F.col("p.size"))
    out = rows.join(plan, same).select("d.*", "source_size", "target", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
    taken = {c.lower() for c in docs.columns}
    return packed.unpack(out, *[F.col(c).alias(f"mix_{c}" if c in taken else c) for c in ("size", "source_size", "target", "copy")])
