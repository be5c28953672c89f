"""Documents between the close tags of XML files that Spark cuts anywhere.

Files are read by Spark's line reader with the beginning of the close tag as
the line's end. Whether a cut is a true one depends on what came before: it
isn't inside a comment, a CDATA section or an instruction, nor where a longer
name only begins like the tag. A piece maps the state in which it is entered to
the one in which it is left; these maps are put together over a split, then
over the splits of a file, and then each piece knows how it is entered. Only
pieces at a false cut are moved, to the piece they belong to.
"""

from __future__ import annotations

import re

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import cut, drop_cut

#: What opens and what ends the parts of XML that hold no tags (fixed values).
OPAQUE = {"<!--": "-->", "<![CDATA[": "]]>", "<?": "?>"}
#: States: in content, or before the end of an opaque part.
STATES = ("", *OPAQUE.values())
OPENS = re.compile("|".join(map(re.escape, OPAQUE)))
REST_OF_TAG = re.compile(r"[ \t\r\n]*>")


def left_in(piece: str, state: int) -> int:
    """The state in which a piece is left that is entered in one."""
    at = 0
    while True:
        if state:
            end = piece.find(STATES[state], at)
            if end < 0:
                return state
            at = end + len(STATES[state])
        m = OPENS.search(piece, at)
        if m is None:
            return 0
        at, state = m.end(), STATES.index(OPAQUE[m[0]])


def _heads(pieces: pd.DataFrame, state: int) -> tuple[int, list[int]]:
    """The state after a split's pieces, and the piece each of them belongs to (-1: one of an earlier split)."""
    head, found = -1, []
    for place, block, left, tag in zip(pieces["place"], pieces["block"], pieces["left"], pieces["tag"], strict=True):
        first_of_file = block == 0 and not found
        if first_of_file or (state == 0 and tag):
            head = place
        found.append(head)
        state = int(left[state])
    return state, found


def _split_map(pieces: pd.DataFrame) -> pd.DataFrame:
    ends = [_heads(pieces.sort_values("place"), s) for s in range(len(STATES))]
    return pd.DataFrame({"path": pieces["path"].iloc[:1].values, "block": pieces["block"].iloc[:1].values, "ends": [[e for e, _ in ends]], "heads": [[h[-1] for _, h in ends]]})


def _entries(splits: pd.DataFrame) -> pd.DataFrame:
    out, state, head = [], 0, -1
    for path, block, ends, heads in splits.sort_values("block")[["path", "block", "ends", "heads"]].itertuples(index=False):
        out.append((path, block, state, head))
        head = heads[state] if heads[state] >= 0 else head
        state = ends[state]
    return pd.DataFrame(out, columns=["path", "block", "state", "head"])


def _members(pieces: pd.DataFrame) -> pd.DataFrame:
    pieces = pieces.sort_values("place")
    before = pieces["head"].iloc[0]
    heads = [before if h < 0 else h for h in _heads(pieces, int(pieces["state"].iloc[0]))[1]]
    out = pd.DataFrame({"place": pieces["place"], "head": heads})
    return out[out["place"] != out["head"]]


def documents(spark: SparkSession, path: str, close: str, encoding: str = "UTF-8") -> DataFrame:
    """path, block, place, value: the text before each close tag, without it, and what follows the last one.

    close: the close tag without its end, as in "</name"; white space may follow.
    The texts are written once to the shared folder, which fixes their places;
    drop_cut() of the result deletes them. One task holds the small rows (no
    texts) of a split, or one row for each split of a file.
    """
    raw = spark.read.option("lineSep", close).option("encoding", encoding).text(path)
    placed = raw.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"), "value")

    def described(batches):
        for b in batches:
            values = b.column("value").to_pylist()
            left = ["".join([str(left_in(v, s)) for s in range(len(STATES))]) for v in values]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(left, pa.string()), pa.array([REST_OF_TAG.match(v) is not None for v in values])], [*b.schema.names, "left", "tag"])

    pieces = cut(placed.mapInArrow(described, "path string, block long, place long, value string, left string, tag boolean"))
    small = pieces.drop("value")
    by_split = small.groupBy("path", "block").applyInPandas(_split_map, "path string, block long, ends array<int>, heads array<long>")
    entered = by_split.groupBy("path").applyInPandas(_entries, "path string, block long, state int, head long")
    members = cut(small.hint("merge").join(entered, ["path", "block"]).groupBy("path", "block").applyInPandas(_members, "place long, head long"))
    columns = ["path", "block", "place", "value"]
    if members.isEmpty():
        drop_cut(members)
        out = pieces.select(*columns)
    else:
        linked = members.unionAll(members.select(F.col("head").alias("place"), "head").distinct())
        whole = pieces.join(linked.hint("merge"), "place").groupBy("path", "head").agg(F.array_sort(F.collect_list(F.struct("block", "place", "value"))).alias("p"))
        whole = whole.select("path", F.col("p")[0]["block"].alias("block"), F.col("p")[0]["place"].alias("place"), F.array_join(F.col("p.value"), close).alias("value"))
        out = pieces.join(linked.hint("merge"), "place", "left_anti").select(*columns).unionByName(whole)
    out._docketlake_path = pieces._docketlake_path
    return out
