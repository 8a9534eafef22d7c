"""Materialized pipeline: tables, views, CSV; same answers as the lazy plan."""
from encore.config import DEFAULT
from encore.plans import pipeline as P
from encore.plans import views as V
from encore.plans.stages import Stages
from encore.sources.plays import raw_from_events
from tests.conftest import SF_SMALL


def test_materialize_and_views(spark, tmp_path):
    raw = raw_from_events(spark, SF_SMALL)
    st = P.materialize(spark, raw, str(tmp_path / "tables"), DEFAULT)
    lazy = Stages(spark, SF_SMALL, DEFAULT)
    assert st.sessions.exceptAll(lazy.sessions).count() == 0
    assert st.sessions.count() == lazy.sessions.count()
    views = P.register_views(st)
    for name in V.NAMES:
        a, b = views[name], getattr(V, name)(lazy)
        assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0, name
    assert spark.sql("SELECT count(*) FROM view_top_content").first()[0] == views["view_top_content"].count()
    P.export_csv(st, str(tmp_path))
    back = spark.read.option("header", True).csv(str(tmp_path / "csv/view_yearly_trends"))
    assert back.count() == views["view_yearly_trends"].count()


def test_profile_feeds_the_distributions(spark, tmp_path):
    """The profiling distributions read from the one-pass profile table give
    the same rows as the focused aggregates over raw."""
    from encore.plans import eda as EDA
    raw = raw_from_events(spark, SF_SMALL)
    st = P.materialize(spark, raw, str(tmp_path / "tables"), DEFAULT)
    assert st.profile_table is not None
    lazy = Stages(spark, SF_SMALL, DEFAULT)
    for name in EDA.NAMES:
        a, b = getattr(EDA, name)(st), getattr(EDA, name)(lazy)
        assert a.columns == b.columns, name
        assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0, name


def test_expectations_hold(spark):
    from encore.plans.quality import expectations
    from tests.conftest import SF_MID
    exp = expectations(Stages(spark, SF_MID, DEFAULT)).collect()
    assert len(exp) == 6 * 4                      # six expectations, four accounts
    assert all(r.passed for r in exp), [r for r in exp if not r.passed]


def test_sql_on_registered_tables(spark, tmp_path):
    """Source-style SQL runs by name on the registered tables and views."""
    raw = raw_from_events(spark, SF_SMALL)
    st = P.materialize(spark, raw, str(tmp_path / "tables"), DEFAULT)
    P.register_views(st)
    n = spark.sql("SELECT count(*) FROM streaming_history_raw WHERE episode_name IS NULL").first()[0]
    m = spark.sql("SELECT sum(tracks_played) FROM sessions").first()[0]
    assert n == 1008 and m == st.silver.count() == 988
