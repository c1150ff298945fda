from cases import edge_docs, edge_texts, empty_docs, words

from ebbflow.llm import decontaminate as d
from ebbflow.llm.common import table

ITEMS = [
    (1, "Tom has 12 apples and gives 5 apples to Anna so that Tom keeps some apples for the long winter days ahead."),
    (2, words(7, 30)),
    (2, words(7, 30)),
    (3, "one short item here indeed"),
    (4, "tiny"),
    (5, None),
    (6, ""),
    (None, words(8, 30)),
]


def items(spark, rows=ITEMS):
    return spark.createDataFrame([(*r, "x", None) for r in rows], "item_id long, text string, slots string, at string")


def found(spark, texts, rows=ITEMS):
    docs = edge_docs(spark, list(enumerate(texts)))
    return {r.doc_id: (r.contaminated, r.kind, list(r.item_ids)) for r in d.contamination(docs, items(spark, rows)).collect()}


def test_templates_and_slots(spark):
    item = ITEMS[0][1]
    other = item.replace("Tom", "Ben").replace("12", "31").replace("Anna", "Zoe").replace("5", "9")
    mixed = other.replace("so that Ben", "so that Max")  # the second Ben is another name: no consistent slots
    rows = found(
        spark,
        [item, words(1, 9) + " " + item.upper() + " " + words(2, 9), other, mixed, words(3, 200), words(7, 30)[5:],
         "one short item here indeed", "well one short item here indeed yes", "tiny", "a tiny thing", "1 2 3 4 5 6 7 8 9 10 11 12 13 14"],
    )
    assert rows[0] == rows[1] == (True, "verbatim", [1])
    assert rows[2] == (True, "re-parameterised", [1])
    assert rows[3][2] in ([], [1]) and rows[4] == (False, None, [])
    assert rows[5] == (True, "verbatim", [2])
    assert rows[6] == rows[7] == (True, "verbatim", [3])
    assert rows[8] == (True, "verbatim", [4]) and not rows[9][0] and not rows[10][0]


def test_inconsistent_slots_are_no_match(spark):
    item = "When 7 red birds met 7 blue birds near the old mill all 7 sang until 7 in the calm evening light."
    random_slots = "When 4 red birds met 8 blue birds near the old mill all 2 sang until 9 in the calm evening light."
    same = random_slots.replace("8", "4").replace("2", "4").replace("9", "4")
    rows = found(spark, [random_slots, same], [(1, item)])
    assert rows[0][0] is False and rows[1] == (True, "re-parameterised", [1])


def test_edge_cases(spark):
    rows = d.contamination(edge_docs(spark), items(spark)).collect()
    assert len(rows) == len(edge_texts()) and not any(r.contaminated for r in rows)
    assert d.contamination(empty_docs(spark), items(spark)).count() == 0
    assert not any(r.contaminated for r in d.contamination(edge_docs(spark), items(spark, [])).collect())
    kept = d.drop_contaminated(edge_docs(spark, [(1, ITEMS[1][1]), (None, ITEMS[1][1]), (2, "clean"), (None, None)]), items(spark))
    assert sorted(str(r.text) for r in kept.collect()) == ["None", "clean"]
    assert kept.columns == edge_docs(spark).columns


def test_number_dense_and_short_items(spark):
    train = "A train travels 60 km in 2 hours. How many km does it travel in 5 hours?"
    bench = [
        (1, train),
        (2, "What is 12 plus 15 minus 7?"),
        (3, "Where is Anna"),
        (4, "Sum 3 4 5 and 6 7 8 9 10 11 12 13 14"),
    ]
    rows = found(
        spark,
        [
            "He asked: " + train.replace("60", "85").replace("2", "3").replace("5", "7") + " Nobody knew.",
            "so what is 31 plus 9 minus 4? nobody",
            "tell me where is anna today",
            "where is Ben now",
            "3 4 5 6 7 8 9 10 11 12 13 14 15 16 17 18 19 20",
            "Rows 1 2 3 and 4 5 6 7 8 9 10 11 12 13 14 15 16",  # one literal word: a list
            "8 plus 9 minus 4 plus 2 minus 1",
            train.replace("hours. How", "hours. Say how"),  # no run of 13 words
        ],
        bench,
    )
    assert rows[0] == (True, "re-parameterised", [1])
    assert rows[1] == (True, "re-parameterised", [2])
    assert rows[2] == (True, "verbatim", [3])
    assert [rows[k][0] for k in (3, 4, 5, 6, 7)] == [False] * 5


def test_sentence_initial_function_words_are_no_names():
    assert [d.placeholder(w) for w in ("What", "How", "If", "Find", "Tom")] == [None] * 4 + [d.NAME]


def test_null_doc_ids_have_results_of_their_own(spark):
    rows = d.contamination(edge_docs(spark, [(None, ITEMS[1][1]), (None, "clean"), (None, ITEMS[1][1]), (1, "clean")]), items(spark)).collect()
    assert sorted((r.doc_id is None, r.contaminated, list(r.item_ids)) for r in rows) == [
        (False, False, []), (True, False, []), (True, True, [2]), (True, True, [2])
    ]


def plain(text):
    return f" {' '.join(w for w in (d.EDGES.sub('', x).lower() for x in (text or '').split()) if w)} "


def test_documents_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs, bench = table(spark, sf, "documents"), table(spark, sf, "benchmark")
    whole = [(r.item_id, plain(r.text)) for r in bench.collect()]
    got = {r.doc_id: r for r in d.op7_decontaminate(spark, sf).collect()}
    hits = 0
    for r in docs.collect():
        want = sorted(i for i, t in whole if t in plain(r.text))
        assert list(got[r.doc_id].item_ids) == want
        hits += bool(want)
    assert hits > 10
