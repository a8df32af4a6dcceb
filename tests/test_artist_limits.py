"""The documented limits of artists (50 of more than 100 as labels, 50 profiles) drop none of the given table."""

from pyspark.sql import functions as F

from encore.operators import models as ML
from encore.plans import Tables
from encore.plans.models import session_rows
from encore.plans.recommend import artist_profile

FOLDER = "/root/testdata/sf0.001"


def test_no_artist_of_the_given_plays_is_cut(spark):
    t = Tables(spark, FOLDER)
    counts = t.plays.where("artist_id IS NOT NULL").groupBy("artist_id").count()
    assert 15 < counts.count() <= 50
    assert artist_profile(t).count() == counts.where("count > 10").count()
    whole = ML.session_features(t.plays, "ts", "user_id", "event_id", "artist_id", F.col("label") == "click", cap=10**9, gap_minutes=240)
    assert session_rows(t).count() == whole.count()
