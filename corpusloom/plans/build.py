"""The corpus build as one lazy plan: records, blocks, cleaning, split and marked replies."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.dialogue import insert_eos, to_blocks
from ..operators.filters import first_of_equals
from ..operators.sampling import down_sample, split


def build_blocks(sources: dict[str, tuple[DataFrame, str]], id_col: str = "id") -> DataFrame:
    """(source, id, block) of several sources, each a DataFrame and the name of its shape; unknown shapes are left out."""
    from ..operators.dialogue import SHAPES

    parts = [
        to_blocks(rows, shape).select(F.lit(name).alias("source"), F.col(id_col).cast("string").alias("id"), "block")
        for name, (rows, shape) in sources.items()
        if shape in SHAPES
    ]
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def build_corpus(blocks: DataFrame, ratio: Column | None = None) -> DataFrame:
    """(source, id, split, block): distinct blocks, split by source, train down-sampled, replies closed by eos."""
    distinct = first_of_equals(blocks, [F.col("block")], ["source", "id"])
    parts = split(distinct, ["source"], ["id"])
    if ratio is not None:
        train = down_sample(parts.where("split = 'train'"), ratio, ["source"], ["id"])
        parts = train.unionByName(parts.where("split = 'val'"))
    return insert_eos(parts, ["source", "id", "split"])
