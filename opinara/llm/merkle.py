"""Merkle manifest of a corpus: one tree per source, one over the sources, a proof for every document.

Trees have runs of 16.  A run keeps the digests of its nodes; siblings share it, so it is stored once.
Proofs come from pointer jumping: a run points to the run with its parent; in every round each run
takes over the segments and the pointer of the run it points to, which doubles the distance, until all
have reached the root.

Defined for: null fields (written ``-``), empty and long texts, repeated rows and ids (within a source by
id, then leaf digest, null ids first), no documents (no rows).  Columns beyond those named are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved
from .order import join_values, numbered

#: Nodes per run.
WIDTH = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Key of the tree over the sources; those of sources are empty (null) or start with "=".
TOP = "^"
_LINK = ["tree", "level", "run"]


def leaf_digest(values: list[Column]) -> Column:
    """Lowercase hex sha256 of the values, each ``-`` if null, else its UTF-8 size, ``:`` and itself."""
    said = [F.coalesce(F.concat(F.octet_length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string")), F.lit("-"))
            for v in values]
    return F.sha2(F.concat(*said), 256)


def leaves(docs: DataFrame, claimed_text: Column | None = None) -> DataFrame:
    """``(tree, doc_id, leaf, claimed)`` of every document; ``claimed`` is the leaf with another text, else the same."""
    leaf = leaf_digest([F.col(c) for c in FIELDS])
    claimed = leaf if claimed_text is None else leaf_digest([claimed_text if c == "text" else F.col(c) for c in FIELDS])
    return docs.select(F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("tree"), "doc_id",
                       F.unhex(leaf).alias("leaf"), F.unhex(claimed).alias("claimed"), F.monotonically_increasing_id().alias("row"))


def _hex(digests: Column) -> Column:
    return F.lower(F.hex(digests))


def _levels(nodes: DataFrame, name: str) -> tuple[list[DataFrame], DataFrame]:
    """Runs of all levels above ``nodes(tree, pos, digest)``, and ``(tree, digest)`` of what remains of each tree.

    A run 0 of one node has no neighbours, so its node is what remains; all others become a node above.
    """
    levels, tops = [], []
    while True:
        level = len(levels)
        members = F.array_sort(F.collect_list(F.struct("pos", "digest")))
        runs = (nodes.groupBy("tree", F.expr(f"pos div {WIDTH}").alias("run")).agg(members.alias("members"))
                .select("tree", F.lit(level).alias("level"), "run",
                        F.expr("unhex(array_join(transform(members, m -> hex(m.digest)), ''))").alias("digests"),
                        (F.expr("run = 0 and size(members) = 1")).alias("single")))
        runs = saved(runs, f"{name}-{level}")
        levels.append(runs)
        tops.append(runs.where("single").select("tree", F.col("digests").alias("digest")))
        nodes = runs.where("not single").select("tree", F.col("run").alias("pos"), F.unhex(F.sha2(_hex(F.col("digests")), 256)).alias("digest"))
        if nodes.isEmpty():
            break
    out = tops[0]
    for more in tops[1:]:
        out = out.unionByName(more)
    return levels, out


def _pointing(runs: DataFrame) -> DataFrame:
    """Runs with the pointer to the run that holds their parent node, and the place in it."""
    return runs.select(*_LINK, "digests", "single", F.col("tree").alias("to_tree"), (F.col("level") + 1).alias("to_level"),
                       F.expr(f"run div {WIDTH}").alias("to_run"), F.expr(f"cast(run % {WIDTH} as int)").alias("place"))


def _reached(links: DataFrame, depth: int) -> DataFrame:
    """Pointer jumping: ``path`` of every run holds ``(place, digests)`` from its parent's run up to the root.

    A run that is what remains of its tree adds no segment; the first of a path is the source's subroot.
    With ``depth`` runs on the longest way, ceil(log2(depth)) rounds reach the root.
    """
    links = saved(links, "merkle-links")
    for step in range(1, (depth - 1).bit_length() + 1):
        open_ = links.where(F.col("to_run").isNotNull())
        targets = links.where((F.col("level") > 0) | (F.col("tree") == TOP)).select(
            *(F.col(c).alias(f"to_{c}") for c in _LINK), F.col("digests").alias("t_digests"), F.col("single").alias("t_single"),
            F.col("path").alias("t_path"), F.col("subroot").alias("t_subroot"), F.col("place").alias("t_place"),
            F.struct("to_tree", "to_level", "to_run").alias("onward"))
        met = join_values(open_, targets, [f"to_{c}" for c in _LINK], f"merkle-jump-{step}")
        own = F.when(F.col("t_single"), F.expr("cast(array() as array<struct<place:int,digests:binary>>)")).otherwise(
            F.array(F.struct("place", F.col("t_digests").alias("digests"))))
        jumped = met.select(*_LINK, "digests", "single", *(F.col(f"onward.to_{c}").alias(f"to_{c}") for c in _LINK),
                            F.col("t_place").alias("place"), F.concat("path", own, "t_path").alias("path"),
                            F.coalesce("subroot", F.when(F.col("t_single"), F.col("t_digests")), "t_subroot").alias("subroot"))
        links = saved(links.where(F.col("to_run").isNull()).unionByName(jumped), f"merkle-links-{step}")
    return links


def manifest(docs: DataFrame, claimed_text: Column | None = None) -> DataFrame:
    """Every document with its proof: ``(doc_id, leaf, claimed, subroot, root, proof)``.

    ``leaf`` to ``root`` are hex digests; ``proof`` is an array of ``(before, after)``: the hex digests of the
    siblings left and right of the node, from the leaf's run to the root's.
    """
    rows = numbered(saved(leaves(docs, claimed_text), "merkle-leaves"), "tree", [F.col(c) for c in ("doc_id", "leaf", "row")],
                    "merkle-order")
    levels, subroots = _levels(rows.select("tree", "pos", F.col("leaf").alias("digest")), "merkle-source")
    sources = numbered(subroots.select(F.lit(TOP).alias("tree"), F.col("tree").alias("of"), "digest"), "tree", [F.col("of")], "merkle-sources")
    top_levels, root = _levels(sources.select("tree", "pos", "digest"), "merkle-top")
    root = root.collect()  # one digest, or none of no documents
    up = sources.select(F.col("of").alias("tree"), F.lit(True).alias("single"), F.lit(TOP).alias("up_tree"), F.lit(0).alias("up_level"),
                        F.expr(f"pos div {WIDTH}").alias("up_run"), F.expr(f"cast(pos % {WIDTH} as int)").alias("up_place"))
    to = ("tree", "level", "run")
    links = None
    for runs in levels:
        runs = _pointing(runs)
        crossing = runs.where("single").drop("to_tree", "to_level", "to_run", "place").join(up, ["tree", "single"])
        crossing = crossing.select(*_LINK, "digests", "single", *(F.col(f"up_{c}").alias(f"to_{c}") for c in to), F.col("up_place").alias("place"))
        both = runs.where("not single").unionByName(crossing)
        links = both if links is None else links.unionByName(both)
    for runs in top_levels:
        ends = [F.when(~F.col("single"), F.col(f"to_{c}")).alias(f"to_{c}") for c in to]
        links = links.unionByName(_pointing(runs).select(*_LINK, "digests", "single", *ends, "place"))
    links = links.withColumns({"path": F.expr("cast(array() as array<struct<place:int,digests:binary>>)"), "subroot": F.lit(None).cast("binary")})
    links = _reached(links, len(levels) + len(top_levels))
    members = (rows.groupBy("tree", F.expr(f"pos div {WIDTH}").alias("run"))
               .agg(F.array_sort(F.collect_list(F.struct("pos", "doc_id", "leaf", "claimed"))).alias("members")))
    ends = F.lit(root[0]["digest"] if root else None).cast("binary")
    bottom = links.where((F.col("level") == 0) & (F.col("tree") != TOP)).select(
        "tree", "run", "single", "digests", "path", F.coalesce(F.when(F.col("single"), F.col("digests")), "subroot", ends).alias("subroot"))
    spelled = "transform(path, p -> struct(p.place as place, lower(hex(p.digests)) as digests))"
    met = bottom.join(members, ["tree", "run"]).select(
        "single", "subroot", _hex(F.col("digests")).alias("own"), F.expr(spelled).alias("path"), F.posexplode("members").alias("place", "member"))
    segments = F.expr("if(single, path, concat(array(struct(place, own as digests)), path))")
    proof = "transform(segments, s -> struct(substr(s.digests, 1, 64 * s.place) as before, substr(s.digests, 64 * s.place + 65) as after))"
    return (met.withColumn("segments", segments)
            .select("member.doc_id", _hex(F.col("member.leaf")).alias("leaf"), _hex(F.col("member.claimed")).alias("claimed"),
                    _hex(F.col("subroot")).alias("subroot"), _hex(ends).alias("root"), F.expr(proof).alias("proof")))


def folded(leaf: str, proof: str = "proof") -> Column:
    """The root that ``leaf`` (hex) leads to with the siblings of ``proof``."""
    return F.expr(f"aggregate({proof}, {leaf}, (d, s) -> sha2(concat(s.before, d, s.after), 256))")


def proof_digest(proof: str = "proof") -> Column:
    """sha256 of all siblings' hex digests, level by level, left to right."""
    return F.expr(f"sha2(array_join(transform({proof}, s -> concat(s.before, s.after)), ''), 256)")
