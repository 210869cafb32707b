import datetime as dt

import pytest

from tenderloom.schemas import ENRICHMENTS, NOTICES, PROFILES
from tenderloom.session import local_session

AT = dt.datetime(2026, 9, 22, 12, 0, 0)


@pytest.fixture(scope="session")
def spark():
    session = local_session(partitions=4)
    yield session
    session.stop()


@pytest.fixture
def column(spark):
    """Evaluate a column expression over rows of one or more values."""

    def evaluate(expression, rows, schema):
        df = spark.createDataFrame(rows, schema)
        return [r[0] for r in df.select(expression.alias("x")).collect()]

    return evaluate


@pytest.fixture
def make(spark):
    """Build the scoring tables from partial rows; everything not given has a default."""

    class Make:
        @staticmethod
        def _table(schema, defaults, rows):
            filled = [{**defaults, **row} for row in rows]
            return spark.createDataFrame(
                [tuple(r[f.name] for f in schema.fields) for r in filled], schema
            )

        def notices(self, *rows):
            return self._table(
                NOTICES,
                dict(
                    control_number="n1",
                    object_description="Aquisição de computadores e material de informática",
                    state="SP",
                    estimated_value=None,
                    estimated_amount=None,
                    modality_code=6,
                    modality_name="Pregão",
                    published_at=dt.datetime(2026, 9, 1),
                    proposal_opens_at=dt.datetime(2026, 9, 2),
                    proposal_closes_at=AT + dt.timedelta(days=21),
                    source_payload_hash="h",
                    source_updated_at=None,
                ),
                rows or [{}],
            )

        def profiles(self, *rows):
            return self._table(
                PROFILES,
                dict(
                    profile_id="p1", company_id="c1", keywords=[], cnaes=[], states=[],
                    value_min=None, value_max=None, minimum_score=50,
                ),
                rows or [{}],
            )

        def enrichments(self, *rows):
            return self._table(
                ENRICHMENTS,
                dict(control_number="n1", segment="IT_SERVICES", confidence=1.0,
                     generated_at=dt.datetime(2026, 9, 3)),
                rows,
            )

    return Make()
