import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from podium.session import local_session  # noqa: E402
from podium.sources.schemas import ANSWER_CHANGES, TABLES  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, shuffle_partitions=2, **{"spark.sql.codegen.wholeStage": "false"})
    yield session
    session.stop()


@pytest.fixture
def table(spark):
    """Build a feedback table from tuples in schema order."""

    def make(name, rows):
        return spark.createDataFrame(rows, TABLES[name])

    return make


@pytest.fixture
def log(spark):
    def make(rows):
        return spark.createDataFrame(rows, ANSWER_CHANGES)

    return make


@pytest.fixture
def survey(table):
    """One event with a radio, two checkbox questions and a text question with options, and a foreign event."""
    at = dt.datetime(2024, 1, 1)

    def make(n_responses):
        events = [(1, "Event", None, False, None, None, None, "s1"), (2, "Other", None, False, None, None, None, "s2")]
        questions = [
            (10, 1, 1, "Radio?", None, None, True, "radio", False),
            (11, 1, 2, "Boxes?", None, None, False, "checkbox", True),
            (12, 1, 3, "More boxes?", None, None, False, "checkbox", False),
            (13, 1, 4, "Text?", None, None, False, "text", True),
            (20, 2, 1, "Foreign?", None, None, False, "radio", False),
        ]
        options = [(q, q * 100 + o, o, None, None, None, None) for q in (10, 11, 12, 13, 20) for o in (1, 2, 3)]
        return {
            "events": table("events", events),
            "sessions": table("sessions", [(1, 1, None, "Talk"), (2, 2, None, "Foreign talk")]),
            "questions": table("questions", questions),
            "answer_options": table("answer_options", options),
            "responses": table("responses", [(r, 1, f"c{r}", at, at) for r in range(n_responses)]),
        }

    return make
