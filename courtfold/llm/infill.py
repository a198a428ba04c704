"""Fill-in-middle transformation: texts cut into units and rearranged by DuckDB, a batch of rows at a time."""

from __future__ import annotations

from collections.abc import Iterator

import duckdb
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import text_slices
from .work import whole_number

SEED, RATE, SPM_RATE = 42, 50, 80
#: Bytes of text that DuckDB is given at a time; one longer text goes alone.
BYTES = 4 << 20
#: The marks of the three parts, and the units that texts are cut into.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
UNITS = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"


def transformation(table: str, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> str:
    """DuckDB SQL over a table with doc_id and text: n, form, prefix_chars, middle_chars, output and restored of each row.

    The two cuts and the form are drawn from the SHA-256 of seed and id. What is restored is read back from the output and the form alone.
    """
    p, s, m = PREFIX, SUFFIX, MIDDLE
    return f"""
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{UNITS}') AS units, sha256('{seed}:' || coalesce(doc_id::VARCHAR, '')) AS h FROM {table}
), drawn AS (
  SELECT doc_id, t, units, len(units)::BIGINT AS n, ('0x' || h[1:8])::UBIGINT::BIGINT AS h1, ('0x' || h[9:16])::UBIGINT::BIGINT AS h2,
    ('0x' || h[17:24])::UBIGINT::BIGINT AS h3, ('0x' || h[25:32])::UBIGINT::BIGINT AS h4 FROM cut
), parted AS (
  SELECT doc_id, t, n, array_to_string(list_slice(units, 1, least(h1 % (n + 1), h2 % (n + 1))), '') AS prefix,
    array_to_string(list_slice(units, least(h1 % (n + 1), h2 % (n + 1)) + 1, greatest(h1 % (n + 1), h2 % (n + 1))), '') AS middle,
    array_to_string(list_slice(units, greatest(h1 % (n + 1), h2 % (n + 1)) + 1, n), '') AS suffix,
    CASE WHEN t = '' OR contains(t, '{p}') OR contains(t, '{s}') OR contains(t, '{m}') OR h3 % 100 >= {rate} THEN 'plain' WHEN h4 % 100 < {spm_rate} THEN 'spm' ELSE 'psm' END AS form
  FROM drawn
), formed AS (
  SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END::BIGINT AS middle_chars,
    CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '{p}' || prefix || '{s}' || suffix || '{m}' || middle ELSE '{s}' || suffix || '{p}' || prefix || '{m}' || middle END AS output
  FROM parted
), split AS (
  SELECT *, CASE form WHEN 'psm' THEN string_split(output, '{s}') WHEN 'spm' THEN string_split(output, '{p}') END AS halves FROM formed
)
SELECT doc_id, n, form, prefix_chars, middle_chars, output, CASE form
  WHEN 'plain' THEN output
  WHEN 'psm' THEN substr(halves[1], {len(p) + 1}) || split_part(halves[2], '{m}', 2) || split_part(halves[2], '{m}', 1)
  ELSE split_part(halves[2], '{m}', 1) || split_part(halves[2], '{m}', 2) || substr(halves[1], {len(s) + 1}) END AS restored
FROM split"""


DIGESTS = ", sha256(output) AS output_sha256, sha256(restored) AS restored_sha256"


def fill_in_middle(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE, keep_text: bool = True,
) -> DataFrame:
    """One row per document: doc_id, n (units), form, prefix_chars, middle_chars, output_sha256, restored_sha256, and with keep_text the output.

    A unit is a word with the white space before it; white space at the end is one too. Of 100 texts `rate` are rearranged, `spm_rate` of 100 of these suffix first; empty texts and those with a
    mark in them stay plain, without numbers of characters. Null texts are empty. Ids that aren't whole numbers become null, and null ids draw as an empty id does;
    repeated rows are alike. Other columns are ignored, whatever their names. An empty table gives an empty result. A task holds BYTES of
    text, or one longer text, about 12 times over.
    """
    if not (0 <= rate <= 100 and 0 <= spm_rate <= 100):
        raise ValueError("rates are of 100")
    kept = "doc_id, n, form, prefix_chars, middle_chars" + DIGESTS + (", output" if keep_text else "")
    sql = f"SELECT {kept} FROM ({transformation('batch', seed, rate, spm_rate)})"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with duckdb.connect(":memory:", config={"threads": 1}) as db:
            for batch in batches:
                for rows, _, _ in text_slices(batch, "text", BYTES):
                    db.register("batch", pa.Table.from_batches([rows]))
                    yield from db.execute(sql).to_arrow_table().to_batches()
                    db.unregister("batch")

    own = docs.select(whole_number(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"
    return own.mapInArrow(run, schema + (", output string" if keep_text else ""))


ORACLE = f"SELECT doc_id, n, form, prefix_chars, middle_chars{DIGESTS} FROM ({transformation('documents')})"
