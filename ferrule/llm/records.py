"""Current MEDLINE records and their terms, as several problems use them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A term: a maximal run of letters and digits of the lower-cased text; possessive, so that the match never steps back.
TERM = r"[\p{L}\p{N}]++"


def current_records(medline: DataFrame) -> DataFrame:
    """(pmid, ti, ab): of each PMID the row with the latest loaded_at.

    A null loaded_at is the oldest; of rows with equal loaded_at the larger (ti, ab) is taken, null being smallest, so
    the choice is fixed. Rows without a PMID are no records. Older rows fall away before the shuffle.
    """
    rows = medline.where("pmid IS NOT NULL").groupBy("pmid").agg(F.max(F.struct("loaded_at", "ti", "ab")).alias("row"))
    return rows.select("pmid", "row.ti", "row.ab")


def record_terms() -> Column:
    """The array of all terms of ti and ab, repeats included; null counts as empty."""
    return F.regexp_extract_all(F.lower(F.concat_ws("\n", "ti", "ab")), F.lit(TERM), F.lit(0))


#: The same in SQL over the view ``medline``: current rows, then a list of terms.
TERMS_SQL = r"""
cur AS (SELECT pmid, ti, ab FROM (SELECT *, row_number() OVER (PARTITION BY pmid ORDER BY loaded_at DESC NULLS LAST, ti DESC NULLS LAST, ab DESC NULLS LAST) AS r
        FROM medline WHERE pmid IS NOT NULL) WHERE r = 1),
bag AS (SELECT pmid, regexp_extract_all(lower(concat_ws(chr(10), ti, ab)), '[\p{L}\p{N}]+') AS terms FROM cur)"""
