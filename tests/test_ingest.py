import json

import pytest
from pyspark.sql import functions as F

from rankflow.plans.ingest import ingest, ingest_report
from rankflow.plans.recommend import recommend
from rankflow.operators import profile
from rankflow.operators.match import close_names
from rankflow.operators.scale import z_scores
from rankflow.sources.csv_folder import discover, open_folder, read_csv, validate_folder
from rankflow.sources.reports import save_report
from rankflow.sources.buckets import last_mark, read_buckets, upsert_buckets
from rankflow.sources.warehouse import read_table, write_table
from rankflow.streaming.refresh import refresh_profiles, stored_sums


@pytest.fixture()
def folder(tmp_path):
    def put(name, text):
        (tmp_path / name).mkdir()
        (tmp_path / name / f"{name}.csv").write_text(text, encoding="utf-8")

    names = ["Côte d'Ivoire", "Guinea-Bissau", "Ireland", "Japan", "Kenya", "Peru", "Chad", "Fiji", "Mali", "Oman"]
    put("crime", "country,crime_index,safety_index\n" + "".join(f"{n},{i * 10},{100 - i * 10}\n" for i, n in enumerate(names)))
    put("cost", "country,Country.1,cost_of_living_index\nIreland,Iceland,94.5\nIreland,Ireland,50\nJapan,Japan,80\nKENYA ,Kenya,NA\nPeru,Peru,10\nChad,Chad,20\n")
    put("broken", "")
    return str(tmp_path)


def test_ingest_small_folder(spark, folder, tmp_path):
    files = open_folder(spark, folder)
    assert {f.name: f.entity for f in files if not f.error} == {"cost.csv": "country", "crime.csv": "country"}
    report = {r.filename: r for r in validate_folder(spark, files).files.collect()}
    assert report["broken.csv"].status == "error" and report["cost.csv"].duplicate_rows == 1
    assert report["cost.csv"].indicator_type == "cost" and report["crime.csv"].row_count == 10
    out = str(tmp_path / "out")
    result = ingest(spark, folder, out=out + "/table", log=out + "/log")
    table = {r.country_name: r for r in read_table(spark, out + "/table").collect()}
    assert len(table) == 10 and sorted(r.country_id for r in table.values()) == list(range(1, 11))
    assert table["Côte d'Ivoire"].crime_rate == 1.0 and abs(table["Japan"].crime_rate - table["Japan"].safety_rate) < 1e-12
    assert table["Ireland"].cost_of_living_rate < table["Peru"].cost_of_living_rate
    assert all(v is not None for r in table.values() for v in r)
    log = spark.read.parquet(out + "/log").first()
    assert (log.records_processed, log.records_rejected) == (10, 0)
    save_report(ingest_report(result), out + "/report")
    save_report(ingest_report(result), out + "/text", "text")
    with pytest.raises(ValueError):
        save_report(ingest_report(result), out + "/x", "xml")


def test_folder_errors(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        discover(spark, str(tmp_path / "missing"))
    with pytest.raises(ValueError):
        discover(spark, str(tmp_path))


def test_numbers_need_every_cell(spark, tmp_path):
    (tmp_path / "x.csv").write_text("country,a,b\nX,1,2\nY,NA,two\n")
    assert dict(read_csv(spark, str(tmp_path / "x.csv")).drop("_pos").dtypes) == {"country": "string", "a": "double", "b": "string"}


def test_stream_of_ratings_gives_the_batch_sums(spark, tmp_path):
    features = ["a_rate", "b_rate"]
    items = z_scores(spark.createDataFrame([(i, i / 9, (i * 7 % 10) / 9) for i in range(10)], "item int, a_rate double, b_rate double"), features)
    rows = [{"rating_id": i, "user_id": i % 3, "item": i % 10, "rating": float(1 + i % 5), "ts": f"2024-01-01 00:{i:02d}:00"} for i in range(40)]
    source, schema = tmp_path / "in", "rating_id int, user_id int, item int, rating double, ts timestamp"
    source.mkdir()
    want = profile.rating_sums(spark.createDataFrame(rows).select("user_id", "item", "rating"), items, features)
    for part, chunk in enumerate((rows[:25], rows[20:])):  # five ratings are delivered twice
        (source / f"{part}.json").write_text("\n".join(map(json.dumps, chunk)))
        stream = spark.readStream.schema(schema).json(str(source))
        refresh_profiles(stream, items, features, str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination()
    got = {r.user_id: r for r in stored_sums(spark, str(tmp_path / "t")).collect()}
    for r in want.collect():
        assert got[r.user_id].n == r.n and abs(got[r.user_id].syy - r.syy) < 1e-9
        assert all(abs(a - b) < 1e-9 for a, b in zip(got[r.user_id].sxx, r.sxx))
    # a batch of one user rewrites that user's bucket; one more run over the same files changes nothing
    (source / "2.json").write_text(json.dumps(rows[0] | {"rating_id": 99, "ts": "2024-01-01 01:00:00"}))
    for _ in range(2):
        stream = spark.readStream.schema(schema).json(str(source))
        refresh_profiles(stream, items, features, str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination()
    after = {r.user_id: r for r in stored_sums(spark, str(tmp_path / "t")).collect()}
    assert {u: after[u].n - got[u].n for u in got} == {0: 1, 1: 0, 2: 0}
    last = max((tmp_path / "t" / "sums" / "data").glob("write=*"), key=lambda f: int(f.name[6:]))
    assert len(list(last.glob("bucket=*"))) == 1


def test_upsert_rewrites_only_touched_buckets(spark, tmp_path):
    path = str(tmp_path / "t")
    assert read_buckets(spark, path) is None and last_mark(spark, path) is None
    rows = spark.createDataFrame([(i, i * 10) for i in range(100)] + [(None, -1)], "id long, v long")
    assert upsert_buckets(rows.where("false"), path, "id", buckets=16) == [] and read_buckets(spark, path).count() == 0
    assert len(upsert_buckets(rows, path, "id", mark=4)) == 16 and last_mark(spark, path) == 4
    before = read_buckets(spark, path)
    new = spark.createDataFrame([(7, 1, 1), (7, 2, 2), (7, 0, 0)], "id int, v long, _seq long")
    touched = upsert_buckets(new, path, "id", mark=5)
    assert len(touched) == 1 and last_mark(spark, path) == 5
    folders = list((tmp_path / "t" / "data" / "write=3").glob("bucket=*"))
    assert [f.name for f in folders] == [f"bucket={touched[0]}"]
    want = {i: i * 10 for i in range(100)} | {None: -1}
    assert {r.id: r.v for r in before.collect()} == want  # a reader of the old version is not disturbed
    assert {r.id: r.v for r in read_buckets(spark, path).collect()} == want | {7: 2}
    # what a failed write left behind is no version
    before.write.parquet(f"{path}/data/write=4/bucket={touched[0]}")
    assert read_buckets(spark, path).count() == 101
    assert upsert_buckets(new.withColumn("v", F.lit(9).cast("long")), path, "id") == touched
    assert {r.id: r.v for r in read_buckets(spark, path).collect()} == want | {7: 9} and last_mark(spark, path) == 5


def test_versions(spark, tmp_path):
    path = str(tmp_path / "t")
    write_table(spark.range(3), path)
    write_table(read_table(spark, path).where(F.col("id") > 0), path)
    assert read_table(spark, path).count() == 2
    with pytest.raises(ValueError):
        write_table(spark.range(1), path, replace=False)


def test_newest_version_may_be_empty_and_half_written_ones_are_skipped(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id long, name string")
    assert read_table(spark, path) is None
    assert write_table(rows, path) == 1 and read_table(spark, path).count() == 3
    assert write_table(rows.where("false"), path) == 2 and read_table(spark, path).count() == 0
    assert write_table(rows.limit(1), path) == 3 and read_table(spark, path).columns == ["id", "name"]
    (tmp_path / "t" / "version=4").mkdir()
    assert read_table(spark, path).count() == 1 and write_table(rows, path) == 4


def test_quoted_line_break_stays_in_its_cell(spark, tmp_path):
    for name, text in (("plain", 'country,x,note\n"A",1,"say ""hi"""\nB,2,z\n'), ("broken", 'country,x,note\n"A",1,"x\ny"\nB,2,z\n')):
        file = tmp_path / f"{name}.csv"
        file.write_text(text)
        got = read_csv(spark, str(file)).orderBy("_pos").collect()
        assert [(r.country, r.x) for r in got] == [("A", 1.0), ("B", 2.0)]
        assert got[0].note == ('say "hi"' if name == "plain" else "x\ny")


def test_close_names_measures_lower_cased_text(spark):
    left = spark.createDataFrame([("İİİİİİİİİİabc",)], "name string")
    known = spark.createDataFrame([("İİİİİİİİİİ",)], "std_name string")
    assert [r.std_name for r in close_names(left, known, 80).collect()] == ["İİİİİİİİİİ"]


def test_recommend_with_some_of_the_features(spark):
    importance = spark.createDataFrame([(1, "Safety level", 95.0, 0), (1, "English speaking level", 40.0, 1)], "user_id long, category string, importance double, ord int")
    items = spark.createDataFrame([(f"i{k}", k / 9, k / 18) for k in range(10)], "item string, crime_rate double, safety_rate double")
    got = recommend(importance, None, items, n=3).collect()
    assert [r.rank for r in got] == [1, 2, 3]
    with pytest.raises(ValueError):
        recommend(importance, None, items.select("item"))
