import os
import sys
from datetime import datetime, timezone

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ.setdefault("PYSPARK_PYTHON", sys.executable)
os.environ["PYTHONPATH"] = os.path.dirname(os.path.dirname(os.path.abspath(__file__))) + os.pathsep + os.environ.get("PYTHONPATH", "")

SCHEMAS = {
    "books": "book_id bigint, file_path string, folder_id int, title string, authors array<string>, publisher string, description string, isbn string, published string, subjects array<string>, encoding string, html string, flows array<string>, text_bytes int, cover_index int, paged boolean, ingested_at timestamp, field string, form string, key string, element string",
    "opf_metadata": "opf_id bigint, book_id bigint, dates array<string>, creators array<string>, field string",
    "comic_info": "comic_id bigint, book_id bigint, issue_year string, title string",
    "folders": "folder_id int, dir_path string, tz_name string",
    "agents": "agent_id int, agent_kind string, agent_name string, mention string",
    "documents": "doc_id bigint, text string, lang string, source string, size bigint",
    "eval_items": "item_id int, set_name string, lang string, passage string, question string",
    "containers": "container_id int, tokenizer string, capacity_tokens int",
}


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "2g").config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    s.sparkContext.setLogLevel("OFF")
    yield s
    s.stop()


@pytest.fixture
def make(spark, tmp_path):
    """Writes small tables, each with extra columns whose names clash with those the operators use, and returns their folder."""

    def go(**tables) -> str:
        for name, rows in tables.items():
            schema = SCHEMAS[name]
            cols = [c.split()[0] for c in schema.split(", ")]
            data = [tuple(r.get(c) for c in cols) for r in rows]
            spark.createDataFrame(data, schema).coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return go


@pytest.fixture
def noon():
    return datetime(2024, 6, 1, 12, tzinfo=timezone.utc)


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.select(*cols).collect())
