import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]


@pytest.fixture(scope="session")
def spark():
    from plateview.session import local_session

    session = local_session(8, "plateview-tests", memory="8g", partitions=4)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def scorer(spark):
    """A small scorer learned from authored reviews."""
    from plateview.operators.scoring import BayesScorer

    good = ["The food was delicious", "great tasty food and lovely place", "the staff was friendly and great", "beautiful lovely atmosphere"]
    bad = ["slow and rude service", "the service was terribly slow", "awful cold food", "rude staff and slow waiter", "dirty awful place"]
    fine = ["it was okay", "an average place, okay food"]
    rows = [(i, t, c) for i, (t, c) in enumerate([(t, 2) for t in good] + [(t, 0) for t in bad] + [(t, 1) for t in fine])]
    texts = spark.createDataFrame(rows, "review_id long, Review string, label int")
    return BayesScorer.fit(texts, "Review", "label").materialised()
