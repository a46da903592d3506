from pyspark.sql import functions as F

from support import rows
from litsieve.functions.lexicon import Lexicon, parse_lexicon_lines
from litsieve.functions.text import match_key, search_text, word_set
from litsieve.operators import categorize as cz


def test_search_text_skips_nulls_keeps_empty(spark):
    df = spark.createDataFrame([(1, "a", None, "c"), (2, "", "b", None)], "id int, x string, y string, z string")
    got = rows(df.select("id", search_text(["x", "y", "z"]).alias("t")))
    assert got == [(1, "a c"), (2, " b")]


def test_match_key_python_semantics(spark):
    df = spark.createDataFrame([("  Héllo, World!\n",), ("a  b",), ("x_y-z",)], "t string")
    got = [r[0] for r in df.select(match_key("t")).collect()]
    assert got == ["héllo world", "a  b", "x_yz"]


def test_word_set(spark):
    df = spark.createDataFrame([(" The the  CAT\ncat ",)], "t string")
    assert sorted(df.select(word_set("t")).first()[0]) == ["cat", "the"]


def test_lexicon_parsing_rules():
    lex = Lexicon.from_text("a: x, y\nno colon line\nb: z,\na: w\n c : p:q ")
    assert lex.entries == (("a", ("w",)), ("b", ("z",)), ("c", ("p:q",)))


def test_lexicon_lines_as_spark_job(spark):
    lines = spark.createDataFrame([("a: x, y", 1), ("junk", 2), ("b: z", 3), ("a: w", 4)], "line string, line_no int")
    got = rows(parse_lexicon_lines(lines))
    assert got == [("a", 1, "w", 1), ("b", 3, "z", 1)]


def _papers(spark):
    data = [(1, "Alcohol, use", None), (2, "alcohol", "x"), (3, "the cat", "sat"), (4, None, None),
            (5, "end alcohol", None), (6, "mixed methods study", None), (7, "le chat", "the end")]
    return spark.createDataFrame(data, "paper_id long, Title string, Abstract string")


def test_phrase_labels_edges(spark):
    core = Lexicon.from_text("drink: alcohol\nanimal: cat\nmethod: mixed methods\n")
    add = Lexicon.from_text("french: le\nanimal: chat\n")
    out = cz.phrase_labels(_papers(spark), ["Title", "Abstract"], core, add)
    got = dict(rows(out, "paper_id", "primary_category"))
    assert got[1] == "Uncategorized"          # 'alcohol,' is not 'alcohol'
    assert got[2] == "drink"
    assert got[3] == "animal"
    assert got[4] == "Uncategorized"          # all-NULL text
    assert got[5] == "drink"                  # variant at the end
    assert got[6] == "method"                 # variant with a blank
    assert got[7] == "animal, french"         # same category in both lexicons, sorted labels


def test_phrase_labels_join_path_matches(spark):
    core = Lexicon.from_text("drink: alcohol\nanimal: cat\nmethod: mixed methods\nfrench: le\n")
    a = rows(cz.phrase_labels(_papers(spark), ["Title", "Abstract"], core), "paper_id", "primary_category")
    b = rows(cz.phrase_labels_join(_papers(spark), ["Title", "Abstract"], core), "paper_id", "primary_category")
    assert a == b


def test_substring_last_category_wins(spark):
    lex = Lexicon.from_dict({"first": ["cat"], "second": ["at", "ca"], "none": ["zzz"]}, lower=True)
    out = cz.substring_category(_papers(spark), lex, text_cols=["Title", "Abstract"])
    got = {r["paper_id"]: (r["secondary_category"], r["secondary_keywords"]) for r in out.collect()}
    assert got[3] == ("second", "at, ca")
    assert got[4] == (None, "")


def test_regex_metacharacters_are_literal(spark):
    df = spark.createDataFrame([(1, "a.b (x) | y"), (2, "axb")], "paper_id long, t string")
    lex = Lexicon.from_dict({"dot": ["a.b"], "paren": ["(x)"], "pipe": [" | "]}, lower=True)
    out = dict(rows(cz.substring_category(df, lex, text_cols=["t"]), "paper_id", "secondary_category"))
    assert out == {1: "pipe", 2: None}


def test_dimensions_default_and_last_wins(spark):
    dims = {"Population": Lexicon.from_text("kids: cat\nadults: sat\n", lower=True),
            "Empty": Lexicon.from_dict({"x": []})}
    out = cz.tag_dimensions(_papers(spark), dims, text_cols=["Title", "Abstract"])
    got = {r["paper_id"]: (r["Population"], r["Empty"]) for r in out.collect()}
    assert got[3] == ("adults", "Unknown")
    assert got[1] == ("Unknown", "Unknown")


def test_scored_keywords_strategies(spark):
    lex = Lexicon.from_text("a: the, cat, dog\nb: sat, end\n")
    best = {r["paper_id"]: (r["primary_category"], r["match_score"]) for r in
            cz.scored_keywords(_papers(spark), ["Title", "Abstract"], lex, 0.5, "best").collect()}
    first = {r["paper_id"]: r["primary_category"] for r in
             cz.scored_keywords(_papers(spark), ["Title", "Abstract"], lex, 0.5, "first").collect()}
    assert best[3] == ("a", round(2 / 3, 6))
    assert first[3] == "a"
    assert best[7] == ("b", 0.5)
    assert best[2] == ("Uncategorized", 0.0)


def test_paired_labels(spark):
    core = Lexicon.from_text("animal: cat\nfrench: le\n")
    add = Lexicon.from_text("verb: sat\nend: end\n")
    got = dict(rows(cz.paired_labels(_papers(spark), ["Title", "Abstract"], core, add), "paper_id", "primary_category"))
    assert got[3] == "animal + verb"
    assert got[7] == "french + end"
    assert got[2] == "Uncategorized"


def test_split_matched_complement(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "Uncategorized")], "id int, c string")
    m, u = cz.split_matched(df, "c")
    assert m.count() + u.count() == 3
    m2, u2 = cz.split_matched(df, "c", None)
    assert rows(u2, "id") == [(2,)]
    assert F is not None


def test_scored_keywords_fuzzy_word_level(spark):
    df = spark.createDataFrame([(1, "the catt sat"), (2, "nothing here")], "paper_id long, t string")
    lex = Lexicon.from_text("a: cat, sat\n")
    got = {r["paper_id"]: (r["primary_category"], r["match_score"]) for r in
           cz.scored_keywords(df, ["t"], lex, 0.5, "best", fuzzy=True).collect()}
    assert got[1] == ("a", round((0.75 + 1.0) / 2, 6))
    assert got[2][0] == "Uncategorized"


def test_large_lexicon_switches_to_join(spark):
    big = Lexicon.from_dict({f"c{i}": [f"w{i}", f"x{i} y{i}"] for i in range(400)})
    df = spark.createDataFrame([(1, "a w7 b", None), (2, "x3 y3", "w399"), (3, "none", None)],
                               "paper_id long, Title string, Abstract string")
    got = dict(rows(cz.phrase_labels(df, ["Title", "Abstract"], big), "paper_id", "primary_category"))
    assert got == {1: "c7", 2: "c3, c399", 3: "Uncategorized"}


def test_texts_and_labels_are_computed_once_below_filters(spark):
    from litsieve.operators import classify as cl
    df = spark.createDataFrame([(1, "the cat", None), (2, None, None)], "paper_id long, Title string, Abstract string")
    lex = Lexicon.from_text("a: the, cat\nb: dog, the\n")
    cols = ["Title", "Abstract"]
    for labelled in (cz.phrase_labels(df, cols, lex), cz.paired_labels(df, cols, lex, lex), cz.scored_keywords(df, cols, lex),
                     cz.scored_keywords(df, cols, lex, fuzzy=True)):
        for part in cz.split_matched(labelled, "primary_category"):
            plan = part._jdf.queryExecution().optimizedPlan().toString()
            assert plan.count("concat_ws(") == 1, plan
            assert "levenshtein" not in plan
    second = cz.split_matched(cz.substring_category(df, lex, text_cols=cols), "secondary_category", None)[0]
    assert second._jdf.queryExecution().optimizedPlan().toString().count("concat_ws(") == 1
    told = cl.zero_shot_overlap(df, cols, {"x": "the cat", "y": "dog dog"}).filter("prediction <> 'Unknown'")
    assert told._jdf.queryExecution().optimizedPlan().toString().count("concat_ws(") == 1
    assert [r["paper_id"] for r in told.collect()] == [1]


def test_best_word_similarity_matches_plain_distances(spark):
    from litsieve.functions.similarity import best_word_similarity

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            above, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                above, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, above + (x != y))
        return row[-1]
    terms = ["des", "über", "a"]
    lists = [["die", "dess", "über"], [], [""], None, ["\U0001F600b", "übel", "x" * 300, "", "a"], ["die"] * 3, ["éa", "d"]]
    rows = spark.createDataFrame(list(enumerate(lists)), "id int, w array<string>").coalesce(1)
    got = dict(rows.select("id", best_word_similarity("w", terms).alias("s")).collect())
    for i, words in enumerate(lists):
        assert got[i] == [max([1.0 - distance(w, t) / max(len(w), len(t)) for w in words or [] if w], default=0.0) for t in terms], i


def test_signatures_hash_words_in_batches(spark):
    from litsieve.functions.similarity import minhash_signature, minhash_signature_expr
    rows = spark.createDataFrame([(1, ["a", "ü"]), (2, []), (3, ["b"] * 3 + ["a"]), (4, None), (5, [""])], "id int, w array<string>").coalesce(1)
    got = rows.select("id", minhash_signature(F.col("w"), 16).alias("s"), minhash_signature_expr(F.col("w"), 16).alias("e"))
    assert "md5(" not in rows.select(minhash_signature(F.col("w"), 16))._jdf.queryExecution().optimizedPlan().toString()
    found = {r["id"]: (r["s"], r["e"]) for r in got.collect()}
    assert all(found[i][0] == found[i][1] for i in (1, 3, 5))
    assert found[2][0] is None and found[4][0] is None
