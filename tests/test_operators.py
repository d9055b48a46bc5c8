"""Operators on small tables."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from noticeloom.operators import boxes, entities, fuzzy, overlay, resolve, selector
from noticeloom.plans import extract, registry
from noticeloom.plans.config import Config
from noticeloom.sources import files, store
from noticeloom.streaming import claims

TODAY = datetime.date(2018, 5, 1)
BOX = boxes.BOX


def test_selector(spark):
    df = spark.createDataFrame([(1, "a", None, {"k": "v"}), (2, "b", 5, {}), (3, None, 7, None)], "doc_id int, s string, n int, m map<string,string>")
    got = lambda sel: [r.doc_id for r in selector.find(df, sel, ["doc_id"], order="doc_id").collect()]
    assert got({"s": "a"}) == [1] and got({"n": {"$gt": 4, "$lt": 6}}) == [2] and got({"$not": {"n": {"$exists": True}}}) == [1]
    assert got({"s": {"$ne": "a"}}) == [2, 3] and got({"m.k": {"$exists": True}}) == [1] and got({"$or": [{"s": "b"}, {"n": 7}]}) == [2, 3]
    assert got({"n": {"$and": [{"$exists": True}, {"$ne": 5}]}}) == [3] and got({"missing": None}) == [1, 2, 3] and got({"s": {"$in": ["a", "b"]}}) == [1, 2]
    assert got(json.dumps({"$nor": [{"s": "a"}]})) == [2, 3]
    with pytest.raises(selector.SelectorError):
        got({"$gt": 1})


def test_collate_and_vote(spark):
    rows = [(1, 0, "Konzort", 60.0, 0.0, 0.0, 10.0, 10.0), (1, 1, "Konzert", 90.0, 0.0, 0.0, 10.0, 9.5), (1, 2, "x", 80.0, 50.0, 0.0, 5.0, 5.0), (2, 0, "solo", 70.0, 0.0, 0.0, 1.0, 1.0), (2, 1, None, 70.0, 0.0, 0.0, 1.0, 1.0)]
    got = boxes.collate(spark.createDataFrame(rows, BOX)).orderBy("doc_id", "ord").collect()
    assert [(r.doc_id, r.ord, r.text, len(r.replaces)) for r in got] == [(1, 1, "Konzert", 1), (1, 2, "x", 0), (2, 0, "solo", 0)]
    assert got[0].replaces[0].text == "Konzort"
    voted = boxes.vote(boxes.collate(spark.createDataFrame(rows, BOX))).orderBy("doc_id", "ord").collect()
    assert [r.text for r in voted] == ["Konzert", "x", "solo"]
    costs = boxes.substitution_costs(boxes.ballots(boxes.collate(spark.createDataFrame(rows, BOX)))).collect()
    assert {(r.a, r.b) for r in costs} == {("e", "o"), ("o", "e")} and {r.cost for r in costs} == {0.0}


def test_collate_rules():
    box = lambda t, c: {"text": t, "confidence": c, "x": 0.0, "y": 0.0, "width": 10.0, "height": 10.0}
    assert [b["text"] for b in boxes.collate_boxes([box("ab", 5.0), box("cd", 5.0)], 0.8)] == ["ab"]
    assert [b["text"] for b in boxes.collate_boxes([box("ab", 5.0), box("cde", 5.0)], 0.8)] == ["ab", "cde"]
    merged = boxes.collate_boxes([box("a", 1.0), box("b", 2.0), box("c", 3.0)], 0.8)
    assert [b["text"] for b in merged] == ["c"] and [r["text"] for r in merged[0]["replaces"]] == ["a", "b"]


def test_entities(spark):
    df = spark.createDataFrame([(1, "Sa 12.05.2018 Beginn 20:30 Uhr, 12,50 € mail a.b@c.de 23552 Luebeck Hauptstr 12")], "doc_id long, text string")
    got = {r.kind: r.vals for r in entities.distinct_values(entities.extract(df)).collect()}
    assert "12.05.2018" in [v.strip() for v in got["date"]] and got["email"] == ["a.b@c.de"] and got["dayofweek"][0] == "Sa"
    assert any("20:30 Uhr" in v for v in got["datetime"]) and got["city"][0].startswith("23552 Luebeck") and got["price"][-1].endswith("€")


def test_fuzzy_join_is_brute_force(spark):
    import random

    r = random.Random(3)
    words = sorted({"".join(r.choice("ab") for _ in range(r.randint(1, 7))) for _ in range(60)})
    texts = spark.createDataFrame([(w,) for w in words[::2]], "text string")
    terms = spark.createDataFrame([(w, 1) for w in words[1::2]], "term string, count int")
    got = {(x.text, x.term, x.distance) for x in fuzzy.fuzzy_join(texts, terms, nearest=False, share=None).collect()}
    all_ = texts.crossJoin(terms).withColumn("d", F.levenshtein("text", "term")).where("d <= 2").collect()
    assert got == {(x.text, x.term, x.d) for x in all_}
    ranked = fuzzy.suggestions(fuzzy.fuzzy_join(texts, terms, share=None), ("text",), verbose=0)
    assert ranked.count() == len({x.text for x in all_})


def test_dictionaries(spark, tmp_path):
    (tmp_path / "city.txt").write_text("Kiel\nBonn\nkiel\n")
    (tmp_path / "location_kiel.txt").write_text("Hansa\n")
    (tmp_path / "costs.cfg").write_text("a|b|0.5\nbad|x\n ||0.5\n")
    terms = fuzzy.dictionary(fuzzy.read_dictionaries(spark, str(tmp_path)))
    assert {(r.dict_key, r.subkey, r.term, r["count"]) for r in terms.collect()} == {("city", None, "kiel", 2), ("city", None, "bonn", 1), ("location", "kiel", "hansa", 1)}
    costs = fuzzy.read_costs(spark, str(tmp_path / "costs.cfg")).orderBy("a").collect()
    assert [(r.a, r.b, r.cost) for r in costs] == [(" ", "", 0.5), ("a", "b", 0.5)]
    assert [r.value for r in fuzzy.cost_lines(fuzzy.read_costs(spark, str(tmp_path / "costs.cfg"))).orderBy("value").collect()] == [" ||0.5", "a|b|0.5"]


def test_overlay_is_idempotent(spark):
    df = spark.createDataFrame([(("u", None), ("s", "t")), (("", "v"), ("s", None))], "user struct<a:string,b:string>, server struct<a:string,b:string>")
    once = overlay.overlay_struct(df, "user", "server")
    assert [tuple(r.event) for r in once.collect()] == [("u", "t"), ("s", "v")]
    assert [tuple(r.e2) for r in overlay.overlay_struct(once, "user", "event", "e2").collect()] == [("u", "t"), ("s", "v")]
    assert [tuple(r.event) for r in overlay.merge_struct(df, "user", "server").collect()] == [("u", "t"), ("", "v")]
    assert [tuple(r.user_event) for r in overlay.diff_struct(overlay.merge_struct(df, "user", "server"), "event", "server").collect()] == [("u", None), ("", "v")]


def test_store(spark, tmp_path):
    base = spark.createDataFrame([("a", "1-x", "one", False), ("b", "3-y", "two", False)], "doc_id string, rev string, value string, deleted boolean")
    new = spark.createDataFrame([("b", None, "three", False), ("c", None, "four", False)], base.schema)
    merged = {r.doc_id: (r.value, r.rev.split("-")[0]) for r in store.upsert(base, new).collect()}
    assert merged == {"a": ("one", "1"), "b": ("three", "4"), "c": ("four", "1")}
    ok, bad = store.compare_and_set(base, spark.createDataFrame([("a", "1-x", "new", False), ("b", "2-z", "lost", False)], base.schema))
    assert {r.doc_id: r.value for r in ok.collect()} == {"a": "new", "b": "two"} and [r.doc_id for r in bad.collect()] == ["b"]
    assert [r.doc_id for r in store.live(store.tombstone(base, base.where("doc_id = 'a'"))).collect()] == ["b"]
    left, right = store.replicate(base, spark.createDataFrame([("b", "10-a", "ten", False)], base.schema))
    assert {r.doc_id: r.value for r in left.collect()} == {r.doc_id: r.value for r in right.collect()} == {"a": "one", "b": "ten"}
    assert {r.doc_id: r.value for r in store.update_field(base, spark.createDataFrame([("a", "z")], "doc_id string, value string"), "value").collect()} == {"a": "z", "b": "two"}
    shots = store.Snapshots(spark, f"file://{tmp_path}/t")
    assert shots.read() is None
    shots.write(base)
    shots.write(store.upsert(shots.read(), new))
    assert shots.read().count() == 3 and shots.version() == 2 and shots.read(1).count() == 2
    # of two writers that both saw version 2 the second fails, and nothing of it is read
    assert shots.write(base, after=2) == 3
    with pytest.raises(RuntimeError):
        shots.write(base.limit(1), after=2)
    assert shots.version() == 3 and shots.read().count() == 2
    named, links = store.results(spark.createDataFrame([(1, ""), (2, "T")], "doc_id long, title string"))
    assert [r.title for r in named.orderBy("doc_id").collect()] == ["Unbekannt", "T"] and links.count() == 2


def test_stream_equals_batch(spark, tmp_path):
    from noticeloom.sources.store import Snapshots

    docs = spark.createDataFrame([(str(i), None, f"text {i}") for i in range(20)], "doc_id string, rev string, value string")
    docs.repartition(4).write.parquet(str(tmp_path / "in"))
    sink, dead = Snapshots(spark, f"file://{tmp_path}/out"), Snapshots(spark, f"file://{tmp_path}/dead")
    work = lambda df: df.withColumn("value", F.upper("value"))
    feed = files.change_feed(spark, str(tmp_path / "in"), docs.schema, 1)
    claims.processed(feed, work, sink, str(tmp_path / "ck"), dead=dead).awaitTermination()
    assert {(r.doc_id, r.value) for r in sink.read().collect()} == {(r.doc_id, r.value) for r in work(docs).collect()} and dead.read() is None

    def fail(df):
        raise ValueError("no")

    claims.processed(files.change_feed(spark, str(tmp_path / "in"), docs.schema, 9), fail, sink, str(tmp_path / "ck2"), dead=dead).awaitTermination()
    assert dead.read().count() == 20 and "no" in dead.read().first().error


def test_engines_claim_and_release(spark, tmp_path):
    from noticeloom.sources.store import Snapshots

    picture = F.create_map(F.lit("userimage"), F.struct(F.lit("image/png").alias("content_type"), F.lit("x").cast("binary").alias("data")))
    none = F.lit(None).cast("string")
    docs = spark.range(4).select(F.col("id").cast("string").alias("doc_id"), F.lit("1-a").alias("rev"), F.when(F.col("id") == 3, "other").alias("processed_by"), none.alias("event_id"), picture.alias("attachments"))
    documents = Snapshots(spark, f"file://{tmp_path}/docs")
    documents.write(docs)
    stale = docs.withColumn("rev", F.when(F.col("doc_id") == "2", "0-z").otherwise(F.col("rev")))
    got = claims.claim(documents, stale, "one")
    assert {r.doc_id for r in got.collect()} == {"0", "1"}  # 2 is another revision, 3 is taken
    assert claims.claim(documents, stale, "two").count() == 0
    assert {r.doc_id: r.processed_by for r in documents.read().collect()} == {"0": "one", "1": "one", "2": None, "3": "other"}
    claims.release(documents, got, "one")
    assert {r.doc_id: r.processed_by for r in documents.read().collect()} == {"0": None, "1": None, "2": None, "3": "other"}

    docs.where("processed_by IS NULL").drop("attachments").write.parquet(str(tmp_path / "in"))
    feed = lambda: files.change_feed(spark, str(tmp_path / "in"), docs.drop("attachments").schema, 9)
    current = documents.read().select("doc_id", "rev")
    seen = []

    def work(df):
        seen.append(df.count())
        raise ValueError("no")

    dead, sink = Snapshots(spark, f"file://{tmp_path}/dead"), Snapshots(spark, f"file://{tmp_path}/sink")
    claims.processed(feed(), work, sink, str(tmp_path / "ck"), dead=dead, documents=documents, engine="e").awaitTermination()
    assert seen == [1] and dead.read().count() == 3  # of the stream's revisions only that of 2 is the stored one
    assert {r.processed_by for r in documents.read().collect()} == {None, "other"} and current.count() == 4


def test_results_are_saved_and_linked(spark, tmp_path):
    from noticeloom.sources.store import Snapshots

    kind = "map<string,struct<content_type:string,data:binary>>"
    docs = spark.range(3).select("id", F.lit("1-a").alias("rev"), F.lit(None).cast("string").alias("event_id"), F.lit(None).cast(kind).alias("attachments")).withColumnRenamed("id", "doc_id")
    documents, records = Snapshots(spark, f"file://{tmp_path}/d"), Snapshots(spark, f"file://{tmp_path}/e")
    documents.write(docs)
    events = spark.createDataFrame([(0, "Fest", bytearray(b"png")), (1, "", None)], "doc_id long, title string, image binary")
    for _ in range(2):
        store.save_results(events, documents, records)
    assert {(r.event_id, r.title) for r in records.read().collect()} == {("event-0", "Fest"), ("event-1", "Unbekannt")}
    held = {r.doc_id: r for r in documents.read().collect()}
    assert [held[i].event_id for i in range(3)] == ["event-0", "event-1", None] and bytes(held[0].attachments["image"]["data"]) == b"png" and held[1].attachments is None


def test_batch_of_files_and_ids(spark, tmp_path):
    import json

    from noticeloom.plans import batch
    from noticeloom.sources.store import Snapshots

    (tmp_path / "a.json").write_text(json.dumps({"text": [{"text": "Grosses Konzert", "confidence": 95, "x": 1, "y": 1, "width": 500, "height": 80}, {"text": "Sa 12.05.2018", "confidence": 95, "x": 1, "y": 200, "width": 200, "height": 20}]}))
    docs = spark.createDataFrame([("7", "Fest am 13.05.2018 um 20:30 Uhr"), ("8", "nichts")], "doc_id string, text string")
    docs.write.parquet(str(tmp_path / "docs"))
    lines = []
    batch.main(["--documents", str(tmp_path / "docs"), str(tmp_path / "a.json"), "7"], spark, TODAY, lambda x: lines.append(json.loads(x)))
    by = {x["doc_id"].rsplit("/", 1)[-1]: x for x in lines}
    assert set(by) == {"a.json", "7"} and by["a.json"]["title"] == "Grosses Konzert" and by["a.json"]["times"] == ["2018-05-12"] and by["7"]["times"] == ["2018-05-13T20:30:00.000"]
    batch.main(["--documents", str(tmp_path / "docs"), "--out", str(tmp_path / "out"), "7", "8"], spark, TODAY)
    assert spark.read.text(str(tmp_path / "out")).count() == 2
    with pytest.raises(ValueError):
        batch.main(["nowhere"], spark, TODAY)
    for dry in (True, False):
        sink = Snapshots(spark, f"file://{tmp_path}/sink{dry}")
        batch.stream(spark, str(tmp_path / "docs"), docs.schema, sink, str(tmp_path / f"ck{dry}"), TODAY, Config(dry_run=dry)).awaitTermination()
        assert (sink.read() is None) == dry
    assert sink.read().count() == 2


def test_overlay_by_type(spark):
    df = spark.createDataFrame([(([], 0, False, None), (["x"], 5, True, "s")), ((["u"], 2, True, ""), (["x"], 5, False, "s"))],
                               "user struct<l:array<string>,n:int,b:boolean,t:string>, server struct<l:array<string>,n:int,b:boolean,t:string>")
    assert [tuple(r.event) for r in overlay.overlay_struct(df, "user", "server").collect()] == [(["x"], 5, True, "s"), (["u"], 2, True, "s")]


def test_fuzzy_join_by_costs_and_umlauts(spark):
    texts = spark.createDataFrame([("Luebeck",), ("Köln",), ("mlll",)], "text string")
    terms = spark.createDataFrame([("lubeck", 1), ("köln", 1), ("mill", 1)], "term string, count int")
    plain = {(r.text, r.term) for r in fuzzy.fuzzy_join(texts, terms).collect()}
    costs = {(r.text, r.term): r.distance for r in fuzzy.fuzzy_join(texts, terms, costs=[("i", "l", 0.0), ("l", "i", 0.0)]).collect()}
    assert plain == {("Luebeck", "lubeck"), ("Köln", "köln")} and costs == {("Luebeck", "lubeck"): 1.0, ("Köln", "köln"): 0.0, ("mlll", "mill"): 0.0}


def test_resolve(spark):
    rows = [
        (1, 0, "Grosses Konzert", 95.0, 10.0, 10.0, 500.0, 80.0), (1, 1, "Sa 12.05.2018", 95.0, 10.0, 200.0, 200.0, 20.0), (1, 2, "Beginn 20:30 Uhr", 95.0, 10.0, 300.0, 200.0, 20.0),
        (1, 3, "Eintritt 12,50 €", 95.0, 10.0, 400.0, 200.0, 20.0), (1, 4, "Hauptstrasse 12, 23552 Luebeck", 95.0, 10.0, 500.0, 200.0, 20.0)]
    b = spark.createDataFrame(rows, BOX)
    gaz = spark.createDataFrame([("Hauptstrasse 12, 23552 Luebeck", 1.0, 2.0, "Luebeck", "SH", "DE", "23552", "Hauptstrasse 12")],
                                "query string, latitude double, longitude double, city string, region string, country string, postal_code string, address string")
    got = resolve.resolve(b, extract.facts(b), TODAY, gaz).first()
    assert got.title == "Grosses Konzert" and got.times == ["2018-05-12T20:30:00.000"] and got.city == "Luebeck" and got.tickets[0].price == "12,50"
    empty = resolve.resolve(b.limit(0), extract.facts(b.limit(0)), TODAY)
    assert empty.count() == 0
    whole = extract.events(b, b, TODAY, gazetteer=gaz).first()
    assert whole.title == "Grosses Konzert" and whole.times == got.times


def test_registry_and_config(spark, tmp_path):
    @registry.transformer("test-upper")
    def upper(df):
        return df.withColumn("v", F.upper("v"))

    registry.transformer("test-bang")(lambda df: df.withColumn("v", F.concat("v", F.lit("!"))))
    df = spark.createDataFrame([("a",)], "v string")
    assert registry.chain("test-upper", "test-bang")(df).first().v == "A!"
    assert registry.fork(registry.named("test-upper"), lambda d: d, lambda a, b: a.unionByName(b))(df).count() == 2
    with pytest.raises(KeyError):
        registry.named("nothing")
    assert registry.register_functions(spark) and spark.sql("SELECT aligned('ab', 'ab') AS x").first().x == ["a", "b"]
    spark.conf.set("noticeloom.most_edits", "1")
    assert Config.load(spark, {"dry_run": True}) == Config(most_edits=1, dry_run=True)
    spark.conf.unset("noticeloom.most_edits")
    (tmp_path / "c.json").write_text('{"sure": 70}')
    assert files.read_config([str(tmp_path / "none"), str(tmp_path / "c.json")]) == {"sure": 70} and "description" in Config().dump()


def test_sources(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps({"text": [{"text": "a b", "confidence": 91.0, "x": 1, "y": 2, "width": 3, "height": 4}]}))
    (tmp_path / "p.png").write_bytes(b"123")
    rec = files.json_records(spark, str(tmp_path / "r.json"))
    assert rec.select(F.explode("text").alias("t")).first().t.text == "a b"
    assert files.image_files(spark, str(tmp_path)).first()["size"] == 3
    parsed = files.parsed_records(spark.createDataFrame([(1, '{"text":[{"text":"q"}]}'), (2, "{no")], "doc_id int, json string"))
    assert [r.failed for r in parsed.orderBy("doc_id").collect()] == [False, True] and files.boxes_of(parsed).count() == 1
    d = spark.createDataFrame([("a", "1-x", None, None, {"userimage": ("image/png", bytearray(b"ABC"))}), ("b", "1-y", None, "e1", {})], "doc_id string, rev string, processed_by string, event_id string, attachments map<string,struct<content_type:string,data:binary>>")
    assert files.attachment(d, "a", "userimage").first().data == "QUJD" and files.attachment(d, "b", "userimage").first().data == ""
    assert [r.doc_id for r in files.selected_ids(d, selector.NEXT_DOCUMENT).collect()] == ["a"]
    assert claims.released(claims.claimed(d, "e")).where("processed_by IS NULL").count() == 2
    new = store.created(files.image_files(spark, str(tmp_path)), F.col("content"), F.col("content"), F.to_timestamp(F.lit("2018-01-01")))
    assert new.first().attachments["userimage"].data == b"123" and claims.unclaimed(new).count() == 1 and files.event(new, "e1").count() == 0
    e = spark.createDataFrame([("e1", "T")], "event_id string, title string")
    assert [r.doc_id for r in files.posters_of_events(d, e, {"title": "T"}).collect()] == ["b"]
    assert "userimage" in store.attach(d, "userimage", F.lit("x").cast("binary")).where("doc_id = 'b'").first().attachments
    assert "attachments" not in store.serialized(d).first().json
    assert store.id_report(d).first().ids == "a,b" and files.document(d, "a", attachments=False).columns[-1] == "event_id"


def test_extracts_come_from_the_unchanged_text(spark, tmp_path):
    import re

    from noticeloom.plans.queries import QUERIES

    texts = ["Müllerstraße 12, 80331 München, Eintritt 12,50 € am 3. Mär 2018 um 20:30 Uhr, Samstag", "ü10 € – Große Bäckergasse 7; 50667 Köln-Süd", "info@köln.de, über www.köln.de und http://a-b.de/ä", "ä12345 Zürich", "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for kind, pattern in entities.PATTERNS.items():
        got = sorted(tuple(r) for r in QUERIES[f"extract_{kind}"](spark, str(tmp_path)).collect())
        found = [[m[0] for m in re.finditer(pattern, t or "", re.A)] for t in texts]
        want = [[v for v in vs if kind in entities.SHORT_KINDS or len(v.encode()) > 3] for vs in found]
        assert got == [(i, k, v) for i, vs in enumerate(want) for k, v in enumerate(vs)], kind


def test_transposed_names_meet_whole(spark, tmp_path):
    from noticeloom.plans.queries import QUERIES

    names = ["abcdefghijklm", "bacdefghijklm", "abcdefghijkml", "badcefghijklm", "abcdefghixyzw", "ab", "ba"]
    spark.createDataFrame([(n,) for n in [*names, None, "ab"]], "p_name string").write.parquet(f"{tmp_path}/part.parquet")
    got = {(r.a, r.b): r.distance for r in QUERIES["transposition_distance"](spark, str(tmp_path)).collect()}
    near = {(0, 1): 1, (0, 2): 1, (0, 3): 2, (1, 2): 2, (1, 3): 1, (5, 6): 1}
    want = {(n, n): 0 for n in names} | {(names[i], names[j]): d for i, j in near for d in [near[i, j]]}
    assert got == want | {(b, a): d for (a, b), d in want.items()}
