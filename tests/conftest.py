import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

from tidemark.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session("4", 4)
    session.sparkContext.setLogLevel("ERROR")
    if not session.conf.get("spark.checkpoint.dir", None):
        session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))
    yield session
    session.stop()


@pytest.fixture
def hot(spark):
    """600 rows of 20 authors; one author holds a third of them, and times repeat."""
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(0)
    author = np.where(np.arange(600) % 3 == 0, 0, rng.integers(1, 20, 600))
    day = 86_400_000_000
    pdf = pd.DataFrame(
        {
            "id": np.arange(600), "a": author, "t": rng.integers(0, 60, 600) * day, "v": rng.integers(1, 50, 600).astype(float),
            "y": rng.integers(0, 2, 600), "p": np.round(rng.random(600), 2), "tok": rng.integers(0, 6, 600),
        }
    )
    return pdf, spark.createDataFrame(pdf)
