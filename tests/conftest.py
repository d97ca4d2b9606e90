import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
sys.path.insert(0, str(ROOT / "tests"))

from pagesieve.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("local[4]", **{
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "6g",
        "spark.ui.showConsoleProgress": "false"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def texts(spark):
    """A sources table from a list of texts; the id is the position."""
    def build(items, url="https://shop.example.com/"):
        rows = [(i, url, f"https://cdn.example.com/{i}.js", 1, text) for i, text in enumerate(items)]
        return spark.createDataFrame(
            rows, "page_id long, url string, source string, source_ord int, content string")

    return build
