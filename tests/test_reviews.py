import datetime
import random

import pytest
from pyspark.sql import functions as F

from wareflow.operators import recalls, review_scores, stores, topics
from wareflow.plans.review_queries import recall_feed

T0 = datetime.datetime(2024, 1, 10)


def reviews(spark, rows):
    cells = [(r.get("asin", "a"), i, r.get("text", "fine product here"), float(r.get("rating", 5)), r.get("ts", T0 + datetime.timedelta(days=40 * i)), r.get("verified", True), r.get("votes", 0)) for i, r in enumerate(rows)]
    return spark.createDataFrame(cells, "asin string, review_idx int, text string, rating double, ts timestamp, verified boolean, helpful_votes long")


def test_burst_and_week(spark):
    got = review_scores.temporal_patterns(reviews(spark, [{"ts": T0 + datetime.timedelta(hours=i)} for i in range(6)])).first()
    assert got.burst and got.one_week and not got.recovery and got.temporal_deduction == 25


def test_recovery(spark):
    rows = [{"rating": 1, "ts": T0}, *({"ts": T0 + datetime.timedelta(hours=10 * i)} for i in (1, 2, 3)), {"ts": T0 + datetime.timedelta(days=60)}]
    got = review_scores.temporal_patterns(reviews(spark, rows)).first()
    assert got.recovery and not got.one_week


def test_ten_signals_and_bounds(spark):
    fake = [{"text": "love it highly recommend great product received free in exchange for honest review", "verified": False, "ts": T0} for _ in range(8)]
    got = review_scores.trust_signals(reviews(spark, fake)).first()
    assert len(got.signals) == 10 and 0 <= got.trust_score <= 60 and got.trust_label in ("suspicious", "questionable")
    assert {s.id: s.deduction for s in got.signals}["copy-paste"] == 15
    texts = (
        "The hinge still feels tight after a winter outdoors.", "Strap length suits my daughter, though the buckle scratches easily and needs care.", "Quiet motor.",
        "Lid seals well; we carry soup to work every day and nothing has leaked so far, even on the bike.", "Cable could be longer but charging speed is what they say.",
    )
    good = [{"text": t, "rating": 3 + i % 3, "votes": 2} for i, t in enumerate(texts)]
    assert review_scores.trust_signals(reviews(spark, good)).first().trust_score >= 85


def test_implied_rating(spark):
    rows = [{"text": "I would have given 5 stars except for the shipping. Quality is great.", "rating": 1}]
    tagged = topics.tagged_sentences(reviews(spark, rows))
    assert topics.adjusted_ratings(tagged, ("shipping-delivery",)).first().adjusted_rating == 5.0
    plain = topics.tagged_sentences(reviews(spark, [{"text": "Shipping was terrible. Product broke.", "rating": 1}]))
    assert topics.adjusted_ratings(plain, ("shipping-delivery",)).first().adjusted_rating == 1.0


def test_substring_tags_and_fallback(spark):
    rows = [{"text": "Nice cups. Nothing else."}]
    got = {r.sentence: r.topics for r in topics.tagged_sentences(reviews(spark, rows)).collect()}
    assert got == {"Nice cups.": ["shipping-delivery"], "Nothing else.": ["product-quality"]}


def test_recall_needs_more_than_one_word(spark):
    items = spark.createDataFrame([(1, "Red Anvil Large Steel", "Red"), (2, "Toaster", "Acme")], "pos int, title string, brand string")
    got = recalls.match_recalls(items, recall_feed(spark)).collect()
    assert {r.pos for r in got} == {1} and "brand" in got[0].matched_on


def test_recall_by_brand_alone_over_two_products(spark):
    items = spark.createDataFrame([(1, "Stainless kettle", "Acme"), (2, "Stainless kettle", "Other"), (3, None, "Acme"), (4, "Stainless kettle", None)], "pos int, title string, brand string")
    one = spark.createDataFrame([(7, [("Acme Toaster",), ("Acme Grill",)], "Appliances can burn", "Fire hazard", [("Shop",)])], "RecallID long, Products array<struct<Name: string>>, Title string, Description string, Retailers array<struct<Name: string>>")
    got = {(r.pos, r.recall_id): (r.confidence, r.matched_on) for r in recalls.match_recalls(items, one).collect()}
    assert got == {(1, 7): (0.5, ["brand"]), (3, 7): (0.5, ["brand"])}


def test_recall_meetings_lose_no_match(spark):
    rng = random.Random(5)
    words = ["small", "red", "kettle", "grill", "lamp", "cord", "acme", "orbit", "lid", "steel", "fan", "toy"]
    some = lambda n: " ".join(rng.choices(words, weights=[9, 9, *[1] * 10], k=n))
    items = spark.createDataFrame([(i, rng.choice([None, some(rng.randint(0, 6))]) if i % 9 == 0 else some(rng.randint(1, 6)), rng.choice([None, "", "Acme", "Orbit", "Red"])) for i in range(150)], "pos int, title string, brand string")
    cells = [(i, [(some(rng.randint(0, 4)),) for _ in range(rng.randint(0, 3))], some(rng.randint(0, 6)), some(rng.randint(0, 8)), [(rng.choice(["Shop", "Retailer"]),)]) for i in range(60)]
    feed = spark.createDataFrame(cells, "RecallID long, Products array<struct<Name: string>>, Title string, Description string, Retailers array<struct<Name: string>>")
    own, theirs = recalls._own_words(items), recalls._recall_words(feed, "retailer")
    for least in (0.2, 0.45, 0.8):
        every = sorted(map(str, recalls._score(own.crossJoin(theirs), least).collect()))
        assert sorted(map(str, recalls.match_recalls(items, feed, least).collect())) == every and every
    with pytest.raises(ValueError):
        recalls.match_recalls(items, feed, 0.0)


def test_recalls_do_not_meet_on_a_word_that_everything_shares(spark):
    items = spark.createDataFrame([(i, f"Small thing{i} orbit" if i == 7 else f"Small thing{i}", None) for i in range(100)], "pos int, title string, brand string")
    one = spark.createDataFrame([(1, [("Small Orbit Lantern",)], "Small lantern burns", "", [("Shop",)])], "RecallID long, Products array<struct<Name: string>>, Title string, Description string, Retailers array<struct<Name: string>>")
    met = recalls.meetings(recalls._own_words(items), recalls._recall_words(one, "retailer"), 0.45).collect()
    assert [r.pos for r in met] == [7]


def test_alerts_and_capacity(spark):
    p = spark.createDataFrame([("a", i, v) for i, v in enumerate((10.0, 8.0, 9.0, 7.0))], "asin string, ts int, price double")
    t = spark.createDataFrame([("a", 8.0)], "asin string, target double")
    assert [r.price for r in stores.price_alerts(p, t).orderBy("ts").collect()] == [8.0, 7.0]
    assert stores.newest(p, 2, "ts", "asin").count() == 2


def test_entropy_of_even_histogram(spark):
    h = review_scores.histograms(reviews(spark, [{"rating": r} for r in (1, 2, 3, 4, 5)]))
    assert abs(h.select(review_scores.entropy()).first()[0] - 2.321928) < 1e-6


def test_model_hook(spark):
    rows = reviews(spark, [{"text": "bad"}, {"text": "good"}])
    got = rows.select(review_scores.sentiment_scorer(lambda ts: [1.0 if "bad" in t else 0.0 for t in ts]).alias("s"), F.col("review_idx")).orderBy("review_idx").collect()
    assert [r.s for r in got] == [1.0, 0.0]


ODD_TEXTS = (
    None, "", "   ", "\n", ". ", "Nice cups... Dr. Who said 4.5 of 5. ok", "I would have given 7 stars but no. It's a 4 star product but slow!", "FAST shipping? Late. Late. late. BATTERY LIFE\tis great.", "Kelvin K sign, café İ. Works with it!\n\nMy fault",
    "a. b. c. fits. fits well. stopped working after a year later", "I'd rate it 3 stars, but the box. I'd give it 2 if not for ups", "e.g. this vs. that etc. The size... Quality",
)


def whole_reviews(spark):
    rng = random.Random(3)
    pieces = [s for t in ODD_TEXTS if t for s in t.split(". ")]
    texts = [*ODD_TEXTS, *(". ".join(rng.choices(pieces, k=rng.randint(1, 6))) for _ in range(150))]
    return reviews(spark, [{"text": t, "asin": rng.choice("abc"), "rating": rng.randint(1, 5)} for t in texts]).cache()


def same(a, b):
    assert sorted(map(str, a.collect())) == sorted(map(str, b.select(*a.columns).collect())) and a.count()


def test_topics_of_whole_reviews_are_those_of_their_sentences(spark):
    rows = whole_reviews(spark)
    same(topics.topic_scores(topics.tagged_sentences(rows)), topics.topic_scores_of_reviews(topics.review_topics(rows)))


def test_trends_of_the_last_quarters_are_those_of_all(spark):
    rows = whole_reviews(spark)
    same(topics.trends(topics.quarter_scores(topics.tagged_sentences(rows))), topics.trends(topics.quarter_scores_of_reviews(topics.review_topics(topics.recent_quarters(rows)))))


def test_stated_ratings_of_whole_reviews_are_those_of_their_sentences(spark):
    rows, ignored = whole_reviews(spark), ("shipping-delivery", "performance")
    same(topics.adjusted_ratings(topics.tagged_sentences(rows), ignored), topics.adjusted_ratings_of_reviews(topics.review_topics(rows, ignored)))


def test_leading_topics_of_whole_reviews_are_those_of_their_sentences(spark):
    rows = whole_reviews(spark)
    same(topics.primary_topics(topics.tagged_sentences(rows)), topics.review_topics(rows).select("asin", "review_idx", F.get("found", F.lit(0))["topic"].alias("primary")))


def test_copied_pairs_meet_only_where_they_share_many_rare_words(spark, monkeypatch):
    rng = random.Random(9)
    vocab = [f"word{i}" for i in range(400)]
    texts = [" ".join(rng.sample(vocab, 30)) for _ in range(120)]
    texts += [" ".join([*rng.choice(texts[:20]).split()[:-k], *rng.sample(vocab, k)]) for k in (1, 2, 4, 6) for _ in range(15)] + texts[:9] + [None, "", "a b c", *["five long words are here"] * 3]
    rows = [{"text": t, "asin": rng.choice(("a", "b", None))} for t in texts]
    sets = [(r["asin"], {w for w in (r["text"] or "").split() if len(w) > 2}) for r in rows]
    want, seen = {}, []
    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if a is not None and a == b and min(len(x), len(y)) >= 5 and len(x & y) / len(x | y) >= 0.7:
                want[a] = want.get(a, 0) + 1
    whole = review_scores._meetings
    monkeypatch.setattr(review_scores, "WORDS_PER_PART", 300)
    monkeypatch.setattr(review_scores, "_meetings", lambda h, t: seen.append(whole(h, t).count()) or whole(h, t))
    got = {r.asin: r.pairs for r in review_scores.copied_pairs(reviews(spark, rows)).collect()}
    assert got == want and seen[0] < 300, "of thousands of pairs"


def test_only_sets_of_pairs_that_may_be_near_are_read_again(spark, monkeypatch):
    rng = random.Random(2)
    vocab = [f"word{i}" for i in range(300)]
    texts = [" ".join(rng.sample(vocab, 40)) for _ in range(150)]
    texts += [" ".join([*t.split()[:-2], "other", "ending"]) for t in texts[:3]]
    again, whole = [], review_scores._of_classes

    def read(sets, classes):
        found = whole(sets, classes)
        again.append((found.count(), classes.count()))
        return found

    monkeypatch.setattr(review_scores, "_of_classes", read)
    got = {r.asin: r.pairs for r in review_scores.copied_pairs(reviews(spark, [{"text": t} for t in texts])).collect()}
    assert got == {"a": 3} and again == [(6, 6)], "of 153 sets"
