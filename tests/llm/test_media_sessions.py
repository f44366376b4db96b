"""The media archive is found by name in threads without an active session, and after another session was the active one."""

from concurrent.futures import ThreadPoolExecutor

from tidecurve.llm import media, queries

FOLDER = "/root/testdata/sf0.001"


def test_media_payload_in_a_thread_of_its_own(spark):
    want = spark.read.parquet(f"{FOLDER}/documents.parquet").count()
    with ThreadPoolExecutor(1) as pool:
        assert pool.submit(lambda: queries.media_payload(spark, FOLDER).count()).result() == want


def test_media_column_after_another_session_was_active(spark):
    other = spark.newSession()
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    other.createDataFrame([(1,)], "x int").count()
    got = media.media_column(docs).select("doc_id", "n_bytes", "payload_bytes").collect()
    assert sorted(map(tuple, got)) == [(1, 1, 64), (2, 0, 64)]
