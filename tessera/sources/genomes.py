"""Chromosome sizes of common genomes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_NAMES = {k: [f"chr{i}" for i in range(1, n + 1)] + ["chrX", "chrY"] for k, n in (("human", 22), ("mouse", 19))}

# Lengths of the assembled chromosomes in order, then X and Y, from the public assemblies.
_SIZES = {
    "hg38": ("human", [248956422, 242193529, 198295559, 190214555, 181538259, 170805979, 159345973, 145138636, 138394717, 133797422, 135086622, 133275309, 114364328, 107043718, 101991189, 90338345, 83257441, 80373285, 58617616, 64444167, 46709983, 50818468, 156040895, 57227415]),
    "hg19": ("human", [249250621, 243199373, 198022430, 191154276, 180915260, 171115067, 159138663, 146364022, 141213431, 135534747, 135006516, 133851895, 115169878, 107349540, 102531392, 90354753, 81195210, 78077248, 59128983, 63025520, 48129895, 51304566, 155270560, 59373566]),
    "mm10": ("mouse", [195471971, 182113224, 160039680, 156508116, 151834684, 149736546, 145441459, 129401213, 124595110, 130694993, 122082543, 120129022, 120421639, 124902244, 104043685, 98207768, 94987271, 90702639, 61431566, 171031299, 91744698]),
    "mm39": ("mouse", [195154279, 181755017, 159745316, 156860686, 151758149, 149588044, 144995196, 130127694, 124359700, 130530862, 121973369, 120092757, 120883175, 125139656, 104073951, 98008968, 95294699, 90720763, 61420004, 169476592, 91455967]),
}
_ALIASES = {"grch38": "hg38", "grch37": "hg19", "grcm38": "mm10", "grcm39": "mm39"}


def chrom_sizes(name: str) -> dict[str, int]:
    """Sizes by name or alias; ValueError if unknown."""
    key = _ALIASES.get(name.lower(), name.lower())
    if key not in _SIZES:
        raise ValueError(f"unknown genome {name!r}; known: {', '.join(sorted(_SIZES))}")
    species, sizes = _SIZES[key]
    return dict(zip(_NAMES[species], sizes, strict=True))


def sizes_frame(spark: SparkSession, sizes: str | dict[str, int]) -> DataFrame:
    """``chrom, size`` of a genome's name, a dict, or a file of two columns."""
    if isinstance(sizes, str):
        try:
            sizes = chrom_sizes(sizes)
        except ValueError:
            if "/" not in sizes and "." not in sizes:
                raise
            text = spark.read.text(sizes).selectExpr("split(trim(value), '\\\\s+') as p").filter("size(p) >= 2")
            return text.selectExpr("p[0] as chrom", "cast(p[1] as bigint) as size")
    return spark.createDataFrame(list(sizes.items()), "chrom string, size long")
