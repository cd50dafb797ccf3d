"""Column helpers that the training-data operators share."""

from pyspark.sql import Column, DataFrame, functions as F

#: Stands for a null id inside an operator: one id below all others.
NO_ID = -(2**63)
SPACE = r"[\x20\x09-\x0D]+"
_SPACES = " \t\n\x0b\x0c\r"


def words(text: Column) -> Column:
    """Runs of anything but the six ASCII spaces; a null or blank text has none."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(_SPACES))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE))


def keyed(docs: DataFrame, id_col: str, text_col: str, *more: Column) -> DataFrame:
    """id, tid, text and `more`: a null text is empty, a null id is NO_ID.

    `tid` is a hash of the text. Rows with one id and one text are repeats of a single document.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64(text).alias("tid"), text.alias("text"), *more
    )


def id_back(name: str = "id") -> Column:
    return F.when(F.col(name) != NO_ID, F.col(name))


def held_out(doc_id: Column, folds: int = 4, fold: int = 2) -> Column:
    """Whether crc32 of the id's digits falls into the fold that is kept from learning."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))
