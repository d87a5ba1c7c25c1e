import pytest
from pyspark.sql import functions as F

#: Columns that documents may have beside their own, of names that the operators use for their own ends.
CLASHING = """_rank _block _nth _group _at _first _key _row _sha _gone _keep _id _k _s _c _crc _copies _trusted _lo _hash _unit _from
    id path block size comp copies places pos hash unit slot shard kept odds p whole rest b1 b2 stop gap source_size target component_id piece length sequence_id""".split()


@pytest.fixture(scope="session")
def docs(spark):
    """Makes a documents table from (doc_id, text[, lang, source]) rows, with clashing extra columns."""

    def make(rows, extra=True):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "src0", len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long")
        return df.select("*", *(F.lit(7).alias(c) for c in CLASHING)) if extra else df

    return make
