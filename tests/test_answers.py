import pytest

from docsearch_spark.operators import ground as G


def model_factory():
    """A factory with a class of its own, both shipped by value."""
    class Model(G.AnswerProvider):
        """Raises as often as the prompt says, then answers; 'none' has no answer."""

        def __init__(self):
            self.failed = {}

        def answer(self, system, user):
            times = 0 if user == "none" else int(user)
            if self.failed.get(user, 0) < times:
                self.failed[user] = self.failed.get(user, 0) + 1
                raise ConnectionError(f"call {self.failed[user]}")
            return None if user == "none" else f" after {times} "

    return lambda: Model()


def test_failures_are_rows_and_do_not_end_the_job(spark):
    factory = model_factory()
    p = spark.createDataFrame([(1, "s", "0"), (2, "s", "2"), (3, "s", "3"), (4, "s", "none")],
                              "query_id long, system string, user string").coalesce(1)
    got = {r.query_id: (r.answer, r.attempts, r.error)
           for r in G.answers_or_errors(p, factory, attempts=3, wait=0.0).collect()}
    assert got == {1: ("after 0", 1, None), 2: ("after 2", 3, None), 3: (None, 3, "ConnectionError: call 3"),
                   4: ("", 1, None)}
    assert G.answers_or_errors(p.limit(0), factory).count() == 0
    with pytest.raises(ValueError):
        G.answers_or_errors(p, factory, attempts=0)
