"""The pipeline and the operators with SQL, on a small table of odd and planted rows."""

import re
from collections import Counter

import duckdb
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from compare import differences
from seqstates.llm import bpe, lines, minhash, queries, templates
from seqstates.llm.common import sieve, table, without
from seqstates.sources import scratch

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text.lower()) if w]


def shingle_set(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def one_word_apart(a, b):
    return any(a[:i] + a[i + 1 :] == b[:i] + b[i + 1 :] for i in range(len(a))) if len(a) == len(b) else any(
        max(a, b, key=len)[:i] + max(a, b, key=len)[i + 1 :] == min(a, b, key=len) for i in range(max(len(a), len(b)))
    )


def units(line):
    s = line.strip(" ").lower()
    if not s:
        return None
    return ("words", s.split(" ")) if s.count(" ") >= 7 else ("letters", list(s))


def without_repeats(rows):
    seen, out = [], []
    for r in rows:
        kept = []
        for line in r["text"].split("\n"):
            w = units(line)
            if w is not None:
                if any(w == v or (len(w[1]) >= 8 and w[0] == v[0] and abs(len(w[1]) - len(v[1])) <= 1 and one_word_apart(w[1], v[1])) for v in seen):
                    seen.append(w)
                    continue
                seen.append(w)
            kept.append(line)
        if kept:
            out.append({**r, "text": "\n".join(kept)})
    return out


def first_of_groups(rows):
    sets = {r["doc_id"]: shingle_set(r["text"]) for r in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for i in ids:
        for j in ids:
            common = len(sets[i] & sets[j])
            if i < j and common and 100 * common >= 75 * (len(sets[i]) + len(sets[j]) - common):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [r for r in rows if find(r["doc_id"]) == r["doc_id"]]


def test_run_equals_brute_force(spark, sf_dir):
    docs = sorted((r.asDict() for r in table(spark, sf_dir, "documents").collect()), key=lambda r: r["doc_id"])
    kept = {r.doc_id for r in corpus_pipeline.keep_known_language(spark, table(spark, sf_dir, "documents"), sf_dir).collect()}
    assert len(kept) >= 0.99 * sum(any(c.isalpha() for c in r["text"] or "") for r in docs)
    rows = first_of_groups(without_repeats([r for r in docs if r["doc_id"] in kept]))
    leaked = {r.doc_id for r in templates.leaks(spark.createDataFrame([tuple(r[c] for c in ("doc_id", "text", "lang", "source", "n_chars")) for r in rows], DOC), table(spark, sf_dir, "benchmark")).collect()}
    items = [" ".join(r.text.lower().split()) for r in table(spark, sf_dir, "benchmark").collect()]
    exact = {r["doc_id"] for r in rows if any(i in " ".join(r["text"].lower().split()) for i in items)}
    assert exact <= leaked
    library = Tokenizer.from_file(bpe.default_path())
    wanted = {r["doc_id"]: len(library.encode(r["text"], add_special_tokens=False).ids) for r in rows if r["doc_id"] not in leaked}
    got = {r.doc_id: r.n_tokens for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert got == wanted


def odd(spark):
    long = " ".join(f"w{i}" for i in range(30_000))
    base = "one two three four five six seven eight nine ten eleven twelve"
    rows = [
        (1, base, "en"), (2, base, "en"), (2, base, "en"), (3, base.replace("three", "changed"), "en"), (4, base + " more", None),
        (5, None, "en"), (6, "", "en"), (7, " \n ", "en"), (8, long, "en"), (9, long + " end", "en"), (None, base, "en"), (None, None, None),
        (10, "a b", "de"), (11, "A  B", "de"), (12, f"start\n{base}\n{base.upper()}\nend", "en"), (13, "\n".join([base] * 4), "en"),
    ]
    return spark.createDataFrame([(i, t, l, "s", len(t or "")) for i, t, l in rows], DOC)


def test_odd_rows(spark):
    docs = odd(spark).selectExpr("*", "'x' AS key", "'x' AS form", "'x' AS component", "'x' AS n")
    near = {r.doc_id: r for r in minhash.near_duplicates(docs).collect() if r.doc_id is not None}
    assert near[2].component_id == 1 and near[9].component_id == 8 and near[11].component_id == 10 and near[10].n_shingles == 1
    assert all(near[i].n_shingles == 0 and near[i].kept for i in (5, 6, 7))
    for i in (3, 4, 12, 13):
        x, y = shingle_set(odd(spark).where(f"doc_id = {i}").first().text), shingle_set(odd(spark).where("doc_id = 1").first().text)
        linked = 100 * len(x & y) >= 75 * len(x | y)
        assert not linked or near[i].component_id == 1
    cut = {(r.doc_id, r.text): r for r in lines.dedupe_lines(docs.where("doc_id IS NOT NULL")).collect()}
    assert (5, None) in cut and (6, "") in cut and (7, " \n ") in cut and (12, "start\nend") in cut and (13, "") in cut and (3, "") in cut and (4, "") in cut
    assert set(docs.columns) <= set(lines.dedupe_lines(docs).columns)
    empty = docs.limit(0)
    assert minhash.near_duplicates(empty).count() == lines.dedupe_lines(empty).count() == 0
    items = spark.createDataFrame([(1, "x")], "item_id long, text string")
    assert templates.leaks(empty, items).count() == templates.leaks(docs, items.limit(0)).count() == templates.leaks(docs, items).count() == 0


def test_new_parameters_and_inconsistent_slots(spark):
    item = "If Anna buys 12 apples and Bert buys 7 pears then how many more apples than pears does Anna carry home after 12 days"
    texts = {
        1: "Quiz. " + item + " today?",
        2: item.replace("12", "31").replace("7", "9").replace("Anna", "Maria"),
        3: item.replace("buys 12", "buys 31").replace("7", "9"),  # 12 stands for two values
        4: "If nothing of that sort is said here then there is nothing at all to find for anyone",
    }
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r for r in templates.leaks(docs, spark.createDataFrame([(9, item)], "item_id long, text string")).collect()}
    assert set(got) == {1, 2} and got[1].n_changed == 0 and got[2].n_changed >= 2
    benchmark = spark.createDataFrame([(9, item)], "item_id long, text string")
    assert differences(templates.leaks(docs, benchmark), duck(docs, benchmark), templates.ORACLE) is None


@pytest.mark.parametrize("name", ["op1_near_duplicates", "op5_line_dedup"])
def test_sql_on_hot_groups(spark, name):
    """A third of the rows are copies, another third near copies."""
    base = [f"w{i}" for i in range(80)]
    rows = [(i, " ".join(base)) for i in range(60)]
    rows += [(100 + i, "\n".join(" ".join([*base[: i % 70], f"x{i}", *base[i % 70 + 1 :]][j : j + 20]) for j in range(0, 80, 20))) for i in range(60)]
    rows += [(200 + i, " ".join(f"u{i}_{j}" for j in range(30))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    connection = duckdb.connect()
    connection.register("documents", docs.toPandas())
    got = minhash.near_duplicates(docs) if name.startswith("op1") else lines.dedupe_lines(docs)
    assert differences(got, connection, queries.ORACLE[name]) is None


def test_line_partner_behind_one_two_words_away(spark):
    line = "one two three four five six seven eight nine ten".split()
    inserted = lambda i, w: [*line[:i], w, *line[i:]]
    texts = [inserted(2, "x"), line, inserted(6, "y"), [w + "'" for w in line], [w + "'" for w in [*line[1:4], line[0], *line[4:]]], [w + "'" for w in line[1:]]]
    docs = [{"doc_id": i, "text": " ".join(w)} for i, w in enumerate(texts)]
    connection = duckdb.connect()
    connection.register("documents", spark.createDataFrame(docs, "doc_id long, text string").toArrow())
    assert differences(lines.dedupe_lines(spark.createDataFrame(docs, "doc_id long, text string")), connection, lines.ORACLE) is None
    got = {r.doc_id: r.text for r in lines.dedupe_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect() if r.text}
    assert got == {r["doc_id"]: r["text"] for r in without_repeats(docs)} and set(got) == {0, 3, 4}


def test_lines_two_words_apart_stay(spark):
    """Both lost a word to the same line, which is not there; the SQL agrees."""
    line = "one two three four five six seven eight nine ten".split()
    texts = [[*line[:i], w, *line[i:]] for i, w in ((2, "x"), (6, "y"))]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string")
    connection = duckdb.connect()
    connection.register("documents", docs.toArrow())
    got = lines.dedupe_lines(docs)
    assert got.where("n_kept = 1").count() == 2 and differences(got, connection, lines.ORACLE) is None


def test_only_the_deciding_rows_go(spark, sf_dir, monkeypatch):
    text = lambda c: " ".join(f"{c}{i}" for i in range(40))
    leak = table(spark, sf_dir, "benchmark").first().text
    rows = [(5, text("a")), (None, text("a")), (None, text("b")), (7, text("a") + " end"), (7, text("c")), (None, leak), (8, leak), (8, text("d")), (9, text("c"))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], DOC)
    pairs = lambda found: sorted(((r.doc_id, r.text) for r in found.collect()), key=str)
    near = [r for r in rows if r not in [(None, text("a")), (7, text("a") + " end"), (None, leak), (9, text("c"))]]
    assert pairs(corpus_pipeline.drop_near_duplicates(spark, docs, sf_dir)) == sorted(near, key=str)
    assert pairs(corpus_pipeline.drop_benchmark_leaks(spark, docs, sf_dir)) == sorted((r for r in rows if r[1] != leak), key=str)
    named = lambda docs, id_col="doc_id": docs.selectExpr(f"{id_col} AS doc_id", "'en' AS lang_pred", "if(text LIKE 'b%' OR text LIKE 'd%', 1.0, 0.1) AS score")
    monkeypatch.setattr(corpus_pipeline.langid, "identify", named)
    assert pairs(corpus_pipeline.keep_known_language(spark, docs, sf_dir)) == sorted([(None, text("b")), (8, text("d"))], key=str)


def test_language_stage_keeps_null_and_shared_ids(spark, sf_dir):
    """The real stage: rows without an id, rows of one id with several texts, repeated rows."""
    rows = [tuple(r[c] for c in ("doc_id", "text", "lang", "source", "n_chars")) for r in table(spark, sf_dir, "documents").where("length(text) > 200").collect()]
    changed = [(None if i % 3 == 0 else 7 if i % 3 == 1 else r[0], *r[1:]) for i, r in enumerate(rows)]
    changed += [changed[0], changed[1], (None, "12 34 !?", "en", "s", 8), (7, None, "en", "s", 0)]
    got = Counter((r.doc_id, r.text) for r in corpus_pipeline.keep_known_language(spark, spark.createDataFrame(changed, DOC), sf_dir).collect())
    wanted = Counter((r[0], r[1]) for r in changed[:-2])
    assert not got - wanted
    lost = wanted - got
    assert sum(lost.values()) <= 0.02 * len(changed), lost
    assert sum(n for (i, _), n in got.items() if i is None) >= 0.3 * len(rows) and sum(n for (i, _), n in got.items() if i == 7) >= 0.3 * len(rows)


def test_leaks_behind_signs_and_one_odd_slot(spark):
    plain = [f"p{c}" for c in "abcdefghijklmnopqrst"]
    items = {
        1: " ".join([*plain, "in 2019 and in 2019", *[f"q{w}" for w in plain]]),
        2: "if a child buys 12 apples and later 7 pears then how many are in the bag that it carries home",
        3: "a ticket costs $12 and a meal costs (15 or more so how much does one pay for them",
        4: "then at last Anna walked to the shop and bought from Bert all that was left of it",
    }
    texts = {
        1: items[1].replace("in 2019 and", "in 2020 and"),
        2: items[2].replace("12", "9").replace("7", "9"),
        3: items[3].replace("12", "31").replace("15", "17"),
        4: items[4].replace("Anna", "(Maria").replace("Bert", '"Carl'),
    }
    docs, benchmark = (spark.createDataFrame(list(x.items()), f"{i} long, text string") for x, i in ((texts, "doc_id"), (items, "item_id")))
    found = templates.leaks(docs, benchmark)
    assert {(r.doc_id, r.item_id) for r in found.collect()} == {(i, i) for i in items}
    assert differences(found, duck(docs, benchmark), templates.ORACLE) is None


def duck(docs, benchmark):
    connection = duckdb.connect()
    connection.register("documents", docs.toArrow())
    connection.register("benchmark", benchmark.toArrow())
    return connection


def test_items_without_a_template_window(spark):
    """Short items and items full of values are found by their own words, whole; the SQL agrees."""
    items = {
        1: "Name the Largest Moon",
        2: "What is the boiling point here",
        3: "3 + 4 * 12 = 51 - 7 + 9 / 2 * 88",
        4: "Anna Bert Carl Dora Emil Fritz Gustav Hanna Ida",
        5: "yes", 6: "- - - - - - - - - -", 7: None, 8: "", 9: "a b c d e f g",
    }
    texts = {
        1: "Quiz:\n  name the *largest* moon?  \nand so on", 2: "please name the largest moon of all",
        3: "Q. What is the boiling point here? It is high", 4: "what is the boiling spot here",
        5: "so 3 + 4 * 12 = 51 - 7 + 9 / 2 * 88 holds", 6: "so 3 + 4 * 12 = 51 - 7 + 8 / 1 * 80 holds",
        7: "they are Anna Bert Carl Dora Emil Fritz Gustav Hanna Ida and more", 8: "they are Anna Carl Bert Dora Fritz Emil Gustav Ida Hanna",
        9: "no\nYES\n", 10: "yes it is", 11: "| - - - - - - - - - - - |", 12: None, 13: "", 14: "a b c d e f", 15: "x a b c d e f g",
    }
    docs, benchmark = (spark.createDataFrame(list(x.items()), f"{i} long, text string") for x, i in ((texts, "doc_id"), (items, "item_id")))
    found = templates.leaks(docs, benchmark)
    assert {(r.doc_id, r.item_id) for r in found.collect()} == {(1, 1), (3, 2), (5, 3), (7, 4), (9, 5), (15, 9)}
    assert differences(found, duck(docs, benchmark), templates.ORACLE) is None
    kept = templates.decontaminate(docs, benchmark)
    assert {r.doc_id for r in kept.collect()} == {2, 4, 6, 8, 10, 11, 12, 13, 14}


def test_short_and_unspaced_lines(spark):
    """Equal lines of every length go, near ones of few words by letters; lines two edits apart stay."""
    spaced = "one two three four five six seven eight nine ten"
    texts = [
        "Menu\nAll rights reserved.\n\u6211\u4eec\u4eca\u5929\u53bb\u516c\u56ed\u6563\u6b65",
        "menu\nAll rights reserved!\n\u6211\u4eec\u660e\u5929\u53bb\u516c\u56ed\u6563\u6b65\n\n",
        "mens\n All right reserved. \n\u6211\u4eec\u53bb\u516c\u56ed\u6563\u6b65\n\n\U0001f600\U0001f601 smiles",
        spaced.replace("two", "two x") + "\n\U0001f600\U0001f602 smiles\nabcdefg\nabcdefx",
        spaced.replace("six", "six y") + "\none two three four five six seven\none two three four five six",
        spaced + "\none two three four five six sevem\n" + spaced.replace("one", "none"),
        spaced.replace("nine ", ""),
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    connection = duckdb.connect()
    connection.register("documents", docs.toPandas())
    got = lines.dedupe_lines(docs)
    assert differences(got, connection, queries.ORACLE["op5_line_dedup"]) is None
    wanted = {r["doc_id"]: r["text"] for r in without_repeats([{"doc_id": i, "text": t} for i, t in enumerate(texts)])}
    kept = {r.doc_id: r.text for r in got.collect()}
    assert {i: t for i, t in kept.items() if t} == {i: t for i, t in wanted.items() if t}


def test_stages_move_and_leave_little(spark, sf_dir):
    """Language detection does not join all texts with the ids that stay; no copy of bands or texts stays after near-dedup."""
    docs = table(spark, sf_dir, "documents")
    kept = corpus_pipeline.keep_known_language(spark, docs, sf_dir)
    assert kept.columns == docs.columns and "LeftSemi" not in kept._jdf.queryExecution().optimizedPlan().toString()
    since = scratch.written_count()
    minhash.near_duplicates(docs).count()
    left = {path.rsplit("/", 1)[1].rsplit("-", 1)[0] for _, path in scratch._written[since:]}
    assert left <= {"classes", "sizes", "links"}


def test_sieve_loses_no_partner(spark):
    rows = spark.range(20_000).selectExpr("id", "if(id % 7 = 0, NULL, xxhash64(id)) AS key", "if(id % 7 = 0, NULL, id) AS row")
    wanted = scratch.materialize(rows.where("id % 100 = 1").select("key", "row"), "wanted")
    passed = {r.id for r in sieve(rows, wanted, "key").collect()}
    hit = {i for i in range(1, 20_000, 100) if i % 7}
    assert hit <= passed and len(passed) < 2 * len(hit)
    assert sieve(rows, wanted.limit(0), "key").count() == 0
    stay = without(rows, wanted.select("row"), "row")
    assert sorted(r.id for r in stay.collect()) == [i for i in range(20_000) if i not in hit]
    assert without(rows, wanted.select("row").limit(0), "row").count() == 20_000
