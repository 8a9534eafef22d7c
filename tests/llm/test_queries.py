"""Every query of this package has SQL, or a test against brute force or labels."""
import __spark_entry__ as E
from encore.llm import queries
from encore.plans import registry

#: Query without SQL -> where it is held against something else.
TESTED = {
    "op3_pii": "test_pii", "op7_ctw": "test_ctw", "op8_toxicity": "test_toxicity",
    "op9_language_id": "test_language_id", "op10_quality_rules": "test_quality_rules", "pipeline": "test_pipeline",
}


def test_every_query_is_accounted_for():
    mine = set(queries.queries()) | {"pipeline"}
    assert set(E.queries()) == set(registry.queries()) | mine
    assert mine - set(E.oracle_sql()) == set(TESTED)
