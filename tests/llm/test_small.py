"""The training-data operators on small fixtures: brute force, nulls, empty texts, ties, repeated rows, clashing columns."""

import itertools
import unicodedata

import pytest
from pyspark.sql import functions as F

from tracelake.llm import consensus, conversations, leakage, packing, pairs, pii, quality, textform

EVENTS = "id string, session_id string, seq bigint, kind string, role string, content string, created_at timestamp_ntz, fault string, part int"


def events(spark, rows):
    import datetime as dt

    t = dt.datetime(2024, 1, 1)
    return spark.createDataFrame([(i, s, n, k, r, c, t + dt.timedelta(seconds=n if at is None else at), "x", 1) for i, s, n, k, r, c, at in rows], EVENTS)


TALKS = {
    "whole": ["u", "a", "a", "u", "a"],
    "system": ["s", "u", "s", "a"],
    "late": ["a", "u", "a"],
    "double": ["u", "u", "a"],
    "open": ["u", "a", "u"],
    "unknown": ["u", "a", "?"],
    "blank": ["u", "a", "u0", "a"],
    "nothing": ["u0"],
    "onlysystem": ["s"],
}
ROLES = {"u": " User", "a": "ASSISTANT ", "s": "system", "?": None}


@pytest.mark.parametrize("width", [3, 50_000])
def test_conversations(spark, monkeypatch, width):
    monkeypatch.setattr(conversations, "SEQ_RANGE", width)
    rows, seq = [], 0
    for name, turns in TALKS.items():
        for i, t in enumerate(turns):
            seq += 1
            rows.append((f"{name}{i}", name, seq, "message", ROLES[t[0]], "​ 　" if t.endswith("0") else f"{name} {i}", None))
    rows += [("whole0", "whole", 1, "message", ROLES["u"], "whole 0", None)]  # the same delivery again
    rows += [("again", "system", 900, "message", "user", "system 1", 7)]  # the same message under a new id, later
    rows += [("t", "tools", 901, "tool_call", "tool", "x", None), ("n", None, 902, "message", "user", "x", None), ("z", "nulltext", 903, "message", "user", None, None)]
    got = {r.session_id: r.fault for r in conversations.broken_sessions(events(spark, rows)).collect()}
    assert got == {"late": "first_turn_not_user", "double": "missing_reply", "open": "missing_reply", "unknown": "unknown_speaker", "nothing": "empty", "onlysystem": "empty", "tools": "empty", "nulltext": "empty"}
    whole = conversations.conversations(events(spark, rows)).where("session_id = 'whole'").orderBy("turn").collect()
    assert [(r.turn, r.role, r.content) for r in whole] == [(i + 1, "user" if t == "u" else "assistant", f"whole {i}") for i, t in enumerate(TALKS["whole"])]
    assert conversations.broken_sessions(events(spark, rows).limit(0)).count() == 0


SAME = [("кот и сок", "кoт и cок"), ("кот", "ｋот".replace("ｋ", "к")), ("abc 12", "ａｂｃ １２"), ("ёж", "ёж"), ("мой", "мой"), ("so­ft", "soft"), ("сор", "cop"), ("Он", "Οн"), ("a​b", "ab"), ("x\ty", "x y"), ("Ёж", "Ëж")]
OTHER = [("ёж", "еж"), ("мой", "мои"), ("Кот", "кот"), ("О1", "01"), ("résumé", "resume"), ("ab", "a b"), ("1", "l"), ("за́мок", "замок")]


@pytest.mark.parametrize("a,b", SAME)
def test_same_look(a, b):
    assert textform.canonical(a) == textform.canonical(b)


@pytest.mark.parametrize("a,b", OTHER)
def test_other_look(a, b):
    assert textform.canonical(a) != textform.canonical(b)


def test_canonical_is_stable():
    for text in itertools.chain(*SAME, *OTHER):
        form = textform.canonical(text)
        assert textform.canonical(form) == form and unicodedata.is_normalized("NFC", form)
    assert textform.canonical(None) is None and textform.canonical("") == ""
    assert textform.canonical("Обычный текст, and plain text") == "Обычный текст, and plain text"
    assert textform.canonical("кoт" * 50_000) == "кот" * 50_000


def test_look_pairs(spark):
    texts = ["кот", "кoт", "кот", None, "", "dog", "ｄog"]
    rows = spark.createDataFrame([(f"i{n}", t, "x") for n, t in enumerate(texts)], "id string, current string, form string")
    assert {tuple(r) for r in textform.same_look_pairs(rows, "id", "current").collect()} == {("i0", "i1"), ("i1", "i2"), ("i5", "i6")}
    assert {(r.id, r.class_id, r.n_spellings) for r in textform.look_classes(rows, "id", "current").collect()} == {("i0", "i0", 2), ("i1", "i0", 2), ("i2", "i0", 2), ("i4", "i4", 1), ("i5", "i5", 2), ("i6", "i5", 2)}
    gold = spark.createDataFrame([("e1", [("кот",), ("пёс",)]), ("e2", []), ("e3", None)], "id string, expected array<struct<evidence_quote:string>>")
    said = spark.createDataFrame([("c1", "e1", "кoт"), ("c1", "e1", "кoт"), ("c2", "e1", "кот"), ("c3", "e1", "пес"), ("c4", "e2", "кот"), ("c5", "e1", None)], "id string, example_id string, evidence_quote string")
    assert {tuple(r) for r in textform.requoted_pairs(said, gold).collect()} == {("c1", "e1")}


PEOPLE = pii.People(["Orlin Lane", "Горян Уляркин", "Caspar-Lo Branch", "Лучезар Ярмуский"])
TEXTS = [
    ("Write to a.b+c@mail.example.org now", "Write to [EMAIL] now"),
    ("to x_y (at) corp (dot) test, please", "to [EMAIL], please"),
    ("x​y@mail.exam​ple", "[EMAIL]"),
    ("pkg@1.2.3 and @dataclass", "pkg@1.2.3 and @dataclass"),
    ("tel +44 20 7946 0308.", "tel [PHONE]."),
    ("call 837-555-0151 or (349) 555 0108", "call [PHONE] or [PHONE]"),
    ("read 1549990112 bytes, seq 000450 to 0000090", "read 1549990112 bytes, seq 000450 to 0000090"),
    ("dial five five five, zero one nine nine nine nine seven at noon", "dial five five five, zero one nine nine nine nine seven at noon"),
    ("call eight zero zero zero four four seven two two five eight", "call [PHONE]"),
    ("SSN 666-66-6831 in clear", "SSN [ID_NUMBER] in clear"),
    ("паспорт серия 0019 № 610373.", "паспорт серия [ID_NUMBER]."),
    ("driver's licence Q462-0962-7184", "driver's licence [ID_NUMBER]"),
    ("I moved to Flat 16, 211 Drorashul Lane, Casnimmere last week", "I moved to [ADDRESS] last week"),
    ("пишите: г. Кесулград, улица Грижанская, 81.", "пишите: [ADDRESS]."),
    ("Calle Nimulpel 28, 7.º B", "[ADDRESS]"),
    ("Hulminzetweg 189, 24069 Drovom", "[ADDRESS]"),
    ("ask O. Lane or LANE, ORLIN or Orlin K. Lane", "ask [PERSON] or [PERSON] or [PERSON]"),
    ("с Горяном Уляркиным и Ярмускому Л.", "с [PERSON] и [PERSON]"),
    ("Orlin left; see the Branch view and line 4 of lane_router.py", "Orlin left; see the Branch view and line 4 of lane_router.py"),
    ("", ""),
]


@pytest.mark.parametrize("text,want", TEXTS)
def test_redaction(text, want):
    assert pii.redact(text, pii.detect(text, PEOPLE)) == want


def test_redaction_keeps_the_rest():
    text = "«при​вет», x　(at)　mail (dot) test — конец " * 3
    out = pii.redact(text, pii.detect(text, PEOPLE))
    assert out == "«при​вет», [EMAIL] — конец " * 3


def test_found(spark):
    rows = spark.createDataFrame([("r1", "a@b.org and a@c.org"), ("r1", "a@b.org and a@c.org"), ("r2", None), ("r3", "")], "record_id string, content string")
    people = spark.createDataFrame([("Orlin Lane",), (None,)], "full_name string")
    assert [tuple(r) for r in pii.found(rows, people).collect()] == [("r1", "email")]
    assert {r.record_id: r.content for r in pii.redacted(rows, people).collect()} == {"r1": "[EMAIL] and [EMAIL]", "r2": None, "r3": ""}


ANSWERS = {
    "empty": [None, "", "​", "n/a", "**Answer:**", "```\n```", "<answer></answer>", "[no answer]"],
    "refusal": ["I'm sorry, but I can't help with that request.", "Leider darauf darf ich nicht antworten."],
    "copy": ["Where did I leave the key", "So, where did I leave the key?", "> Where did I leave the key? Where did I leave the key?"],
    "truncated": ["You left the old key under the st", "You said that the plan had changed, because", "Here it is.\n```json\n{\"a\": ", "The note (about"],
    "language": ["Всего ты закончил 6 записей, если верить последней сессии."],
    None: ["You left the old key under the stairs at Home.", "18", "Grimin", "under the stairs", "you left the old key under the stairs at Home", "Where did I leave the key? — It is in the hall.", "There is nothing about this in the notes I have."],
}


def test_pairs(spark):
    rows, want = [], {}
    for kind, answers in ANSWERS.items():
        for i, a in enumerate(answers):
            want[f"{kind}{i}"] = kind
            rows += [(f"{kind}{i}", "Where did I leave the key?", a, "under the stairs", None)] * 2
    rows += [(None, "q", "a", "g", None), ("noq", None, "Grimin", None, None)]
    frame = spark.createDataFrame(rows, "question_id string, question string, model_answer string, gold_answer_or_rubric string, created_at timestamp_ntz")
    got = {r.question_id: r.defect_type for r in pairs.defects(frame).collect()}
    assert got == {**want, "noq": None}
    assert pairs.defects(frame.limit(0)).count() == 0


def test_length_spike(spark):
    rows = [("x" * 150,)] * 40 + [("y" * n,) for n in range(120, 200)]
    assert [(r.length, r.n) for r in pairs.length_spikes(spark.createDataFrame(rows, "text string")).collect()] == [(150, 41)]


def test_short_last_units(spark):
    said = {
        "full": "You left it at Home.\nUnder the stairs it is.",
        "two": "Under t",
        "line": "Here is what I found.\nYou le",
        "word": "Here is what I found.\nUnd",
        "whole": "Here is what I found.\nYou",
        "one": "Yo",
        "number": "Here is what I found.\n18",
        "numbers": "18 files are there.",
    }
    rows = spark.createDataFrame([(k, t, [None]) for k, t in said.items()], "key string, text string, whole array<string>")
    assert {r.key for r in pairs.shortened(rows).collect()} == {"two", "line", "word"}


def test_length_spike_of_few_texts_by_raw_length(spark):
    rows = [(f"{'x' * 140}{'y' * n}", f"{'*' * (10 - n)}{'x' * 140}{'y' * n}") for n in range(10)] + [("z" * n, "z" * n) for n in (160, 170, 180, 190)]
    frame = spark.createDataFrame(rows, "text string, raw string")
    assert [(r.length, r.n) for r in pairs.length_spikes(frame, measured="raw").collect()] == [(150, 10)]
    assert pairs.length_spikes(frame.limit(0), measured="raw").count() == 0


def test_consensus(spark):
    import random

    rng = random.Random(5)
    truth = {f"q{i}": rng.random() < 0.6 for i in range(300)}
    judges = {"good": (0.95, 0.95), "fine": (0.85, 0.9), "yes": (0.95, 0.1), "contrary": (0.1, 0.15), "coin": (0.5, 0.5)}
    rows, n = [], 0
    for q, right in truth.items():
        for j, (sens, spec) in judges.items():
            said = rng.random() < (sens if right else 1 - spec)
            n += 1
            rows.append((n, q, j.upper() + " ", "rejudge", rng.random() < 0.5, None, rng.choice([" Yes", "T", "1"]) if said else "incorrect", None))
    rows += [(9001, "q0", "good", "rejudge", None, None, "unsure", None), (9002, None, "good", "rejudge", None, None, "yes", None), (9003, "never", "good", "rejudge", None, None, "n/a", None)]
    schema = "vote_id bigint, question_id string, judge string, tool string, original_correct boolean, rejudge_correct string, rejudged string, created_at timestamp_ntz"
    items, judged = consensus.consensus(spark.createDataFrame(rows, schema))
    got = {r.item: r.p > 0.5 for r in items.collect()}
    assert set(got) == set(truth)
    assert sum(got[q] == truth[q] for q in truth) >= 285
    weight = {r.judge: r.weight for r in judged.collect()}
    assert weight["good"] > 0.4 and weight["contrary"] < -0.3 and abs(weight["coin"]) < 0.2


def test_fullest_is_optimal():
    import random

    rng = random.Random(2)
    for _ in range(200):
        items = [rng.randint(1, 30) for _ in range(rng.randint(0, 8))]
        room = rng.randint(0, 60)
        counts = sorted({x: items.count(x) for x in items}.items(), reverse=True)
        best = max(sum(c) for r in range(len(items) + 1) for c in itertools.combinations(items, r) if sum(c) <= room)
        got = packing.fullest(counts, room)
        assert sum(got) == best and all(got.count(x) <= items.count(x) for x in got)


def test_packing(spark, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK", 20)
    sizes = spark.createDataFrame([(i, i % 37) for i in range(100)] + [(500, 64), (501, 200), (501, 200), (502, 0), (503, None)], "doc_id bigint, n_tokens bigint")
    budgets = spark.createDataFrame([("small", 64), ("none", 0), (None, 9)], "budget string, capacity_tokens int")
    rows = packing.pack(sizes, budgets).collect()
    bins, docs = {}, {}
    for r in rows:
        bins[r.bin_id] = bins.get(r.bin_id, 0) + r.tokens
        docs.setdefault(r.doc_id, []).append((r.piece, r.tokens))
    assert max(bins.values()) <= 64
    assert {k: sum(t for _, t in v) for k, v in docs.items()} == {i: i % 37 for i in range(100) if i % 37} | {500: 64, 501: 200}
    assert sorted(docs[501]) == [(0, 64), (1, 64), (2, 64), (3, 8)] and len(docs[500]) == 1
    assert len(bins) <= sum(bins.values()) / 64 + 8
    assert packing.pack(sizes.limit(0), budgets).count() == 0


def test_tokens(spark):
    rows = spark.createDataFrame([(1, "hello world"), (2, ""), (3, None), (None, "x")], "doc_id bigint, text string")
    assert {tuple(r) for r in packing.token_counts(rows).collect()} == {(1, 2), (2, 0), (3, 0)}


def test_leaks_against_brute_force(spark):
    import random

    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(40)]
    items = {i: [rng.choice(vocabulary) for _ in range(rng.randint(5, 40))] for i in range(12)}
    documents = {}
    for d in range(60):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(0, 80))]
        if d % 2:
            item = items[rng.randrange(12)]
            n = rng.randint(8, 20)
            k = rng.randrange(max(1, len(item) - n))
            words[len(words) // 2 : len(words) // 2] = item[k : k + n]
        documents[d] = words
    grams = lambda w: {tuple(w[k : k + 12]) for k in range(len(w) - 11)}
    want = {(d, i) for d, w in documents.items() for i, t in items.items() if grams(w) & grams(t)}
    dress = lambda w, d: (" **".join(x.upper() if d % 3 else x for x in w) + "**!").replace(" ", "\n" if d % 5 == 0 else " ")
    docs = spark.createDataFrame([(d, dress(w, d), "x") for d, w in documents.items()] + [(900, None, "x"), (901, "", "x"), (0, dress(documents[0], 0), "x")], "doc_id bigint, text string, item_text string")
    evals = spark.createDataFrame([(i, ", ".join(t)) for i, t in items.items()] + [(77, None)], "item_id bigint, text string")
    assert {(r.doc_id, r.item_id) for r in leakage.leaks(docs, evals).collect()} == want and len(want) > 5
    assert leakage.leaks(docs.limit(0), evals).count() == 0


FORMS = {
    "prose": ["We decided to keep the snapshot, because the log is cheap to rebuild. It took three attempts.", "# Title\n\nThe plan is to drop it later.\n\n- one thing\n- two\n\nThe rest of the text goes on for a while, and says why it was done.", "Мы решили пометить список файлов, потому что часы одного узла спешат."],
    "list": ["- first\n- second\n- third", "TODO\n1. keep the log\n2. drop the rest\n3. count", "casist lorweszet\nsavoth\ndelist rinhob\nminqua delveryar", "a) one thing;\nb) another thing;\nc) a third (x);"],
    "table": ["a,b,c\n1,2,3\n4,5,6", "| a | b |\n|---|---|\n| 1 | 2 |\n| 3 | 4 |", "run\ttokens\nx\t1\ny\t2", "run     tokens   bytes\nalpha   12       9\nbeta    15       7"],
    "junk": [None, "", " \n​\n", "_________", "lol lol lol lol lol lol lol lol lol lol lol lol", "6f2a 77bc 0e1d a5b4 c3d2", "9jQ2vX0kLmNoPqRsTuVwXyZaBcDeFgHiJkLmNoPqRsTuVwXyZ0123456789abc==", "{{ name }}\n<%= other %>\n%{third}%", "kjs[;sz[gn zd[sjghtdk sj;lglqpsq f[bwqbzm"],
}


def test_forms(spark):
    rows, want = [], {}
    for form, texts in FORMS.items():
        for text in texts:
            want[len(rows)] = form
            rows.append((len(rows), text, "x"))
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, lines string")
    assert {r.doc_id: r.form for r in quality.forms(frame).collect()} == want
    stats = quality.statistics(frame).where(F.col("n_words") == 0).first()
    assert stats.mean_word_length is None and stats.n_lines == 0
    assert quality.forms(frame.limit(0)).count() == 0


BLANK = "This page is intentionally left blank."
REPEATED = [
    "\n".join([BLANK] * 40),
    "\n\n".join([BLANK] * 40),
    " ".join([BLANK] * 40),
    "\n".join(["Please wait, the page that you asked for is not yet here, and we are at work on it."] * 12),
    "\n\n".join(["We keep the log and\nwe drop the rest of it."] * 3 + ["Here is a note that says why."]),
    " ".join(["Мы не нашли то что вы искали на этой странице."] * 20),
]
VARIED = [
    ("list", "\n".join(f"- check the log of the node {chr(97 + i)}{chr(98 + i)}{chr(99 + i)}" for i in range(20))),
    ("prose", "\n".join(["We decided to keep the snapshot, because the log is cheap to rebuild and nobody reads it.", "It took three attempts until the team had found out why the clock of one node was late."] + ["---"] * 5)),
    ("prose", BLANK),
]


def test_repeated_sentences_are_junk(spark):
    rows = [(i, text) for i, text in enumerate([*REPEATED, *(text for _, text in VARIED)])]
    got = {r.doc_id: r.form for r in quality.forms(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert [got[i] for i in range(len(rows))] == ["junk"] * len(REPEATED) + [form for form, _ in VARIED]


def test_statistics_by_hand(spark):
    row = quality.statistics(spark.createDataFrame([(1, "one two.\none two.\n\none two.")], "doc_id bigint, text string")).first()
    assert (row.n_words, row.n_lines, row.punctuated_line_share) == (6, 3, 1.0)
    assert row.duplicate_line_share == pytest.approx(2 / 3) and row.top_bigram_coverage == 1.0


def test_huge_text(spark):
    text = "word " * 300_000
    rows = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    assert quality.forms(rows).first().form == "junk"
    assert packing.token_counts(rows).first().n_tokens > 200_000
    assert pii.redact(text, pii.detect(text, PEOPLE)) == text


def test_last_words_that_other_texts_go_on_after(spark):
    """Whether a text may end in a word is learnt from the other texts, not from a list."""
    said = {f"k{i}": f"The key is zu der Tür number {i} gegangen. It hangs there." for i in range(5)}
    said |= {"open": "Nothing else was found.\nMy old tent hangs zu der", "closed": "Nothing else was found.\nMy old tent hangs there", "once": "Nothing else was found.\nMy old tent hangs qux"}
    rows = spark.createDataFrame([(k, t, [None]) for k, t in said.items()], "key string, text string, whole array<string>")
    assert {r.key: r.sign for r in pairs.shortened(rows).collect()} == {"open": "tail"}


def test_prefixes_of_one_hot_beginning(spark):
    """All units begin alike; they are compared in text order over all of them."""
    said = {f"full{i}": f"You said that the plan with the kiln had changed {'very ' * (i % 7)}much on day {'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}." for i in range(100)}
    said |= {"cut": "You said that the plan with the kiln had cha", "whole": "You said that the plan with the kiln had changed much on day ak"}
    rows = spark.createDataFrame([(k, t, [None]) for k, t in said.items()], "key string, text string, whole array<string>")
    assert {r.key: r.sign for r in pairs.shortened(rows).collect()} == {"cut": "prefix"}
    assert pairs.shortened(rows.limit(0)).count() == 0


NEAR = [("Where did I leave key?", "copy"), ("So, where did leave the key", "copy"), ("I did leave the key where?", None), ("Where did I leave the key and the tent?", None), ("the key", None)]


def test_copies_with_words_left_out(spark):
    rows = spark.createDataFrame([(f"q{i}", "Where did I leave the key?", a, "x", None) for i, (a, _) in enumerate(NEAR)], "question_id string, question string, model_answer string, gold_answer_or_rubric string, created_at timestamp_ntz")
    assert [r.defect_type for r in pairs.defects(rows).orderBy("question_id").collect()] == [want for _, want in NEAR]


def test_reliability_is_the_eigenvector(spark):
    """Against the dense computation with numpy: the fixed point of the overlap-weighted product without the diagonal."""
    import random

    import numpy as np

    rng = random.Random(8)
    rates = [(0.95, 0.05), (0.9, 0.3), (0.99, 0.6), (0.2, 0.8), (0.5, 0.5)]
    truth = [rng.random() < 0.3 for _ in range(2000)]
    ballots = [(f"i{i}", f"j{j}", float(rng.random() < rates[j][0 if right else 1])) for i, right in enumerate(truth) for j in range(5) if rng.random() < 0.8]
    frame = spark.createDataFrame(ballots, "item string, judge string, vote double")
    judges = consensus.judges_of(frame)
    got = {r.judge: r.weight for r in consensus.reliability(consensus.agreement(frame, judges)).collect()}
    votes = np.full((2000, 5), np.nan)
    for i, j, v in ballots:
        votes[int(i[1:]), int(j[1:])] = v
    known = ~np.isnan(votes)
    z = np.where(known, (np.nan_to_num(votes) - np.nanmean(votes, 0)) / np.nanstd(votes, 0), 0)
    n = known.T.astype(float) @ known
    agree = z.T @ z
    np.fill_diagonal(agree, 0)
    np.fill_diagonal(n, 0)
    u = np.ones(5)
    for _ in range(64):
        u = agree @ u / (n @ (u * u))
    u /= np.linalg.norm(u)
    u *= np.sqrt((u @ agree @ u) / ((u * u) @ n @ (u * u)))
    assert [got[f"j{j}"] for j in range(5)] == pytest.approx((u * np.sign(u.sum())).tolist(), abs=1e-3)
    share = consensus.right_share(frame, judges.join(spark.createDataFrame(list(got.items()), "judge string, weight double"), "judge")).first().share
    assert share == pytest.approx(0.3, abs=0.05)


def test_consensus_of_few(spark):
    schema = "vote_id bigint, question_id string, judge string, tool string, original_correct boolean, rejudge_correct string, rejudged string, created_at timestamp_ntz"
    one = spark.createDataFrame([(1, "q", "a", "rejudge", None, None, "yes", None)], schema)
    items, judges = consensus.consensus(one)
    assert items.count() == 1 and judges.first().weight == 0.0
    items, judges = consensus.consensus(one.limit(0))
    assert items.count() == 0 and judges.count() == 0


def test_short_items_inside_long_documents(spark):
    """Items of five words and more in every size partition, against brute force: those under twelve words as a whole."""
    import random

    rng = random.Random(12)
    vocabulary = [f"w{i}" for i in range(12)]
    items = {i: [rng.choice(vocabulary) for _ in range(3 + i % 14)] for i in range(56)}
    documents = {}
    for d in range(80):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(0, 3000 if d % 9 == 0 else 60))]
        for _ in range(d % 4):
            item = items[rng.randrange(56)]
            words[len(words) // 2 : len(words) // 2] = item[: rng.randint(1, len(item))]
        documents[d] = words
    grams = lambda w, n: {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
    want = {(d, i) for d, w in documents.items() for i, t in items.items() if len(t) >= 5 and grams(w, min(len(t), 12)) & grams(t, min(len(t), 12))}
    docs = spark.createDataFrame([(d, " ".join(w)) for d, w in documents.items()], "doc_id bigint, text string")
    evals = spark.createDataFrame([(i, " ".join(t)) for i, t in items.items()], "item_id bigint, text string")
    got = leakage.leaks(docs, evals, short=True).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and {sum(len(items[i]) >= n for n in (5, 8, 12)) for _, i in want} == {1, 2, 3}
    for r in got:
        assert grams(documents[r.doc_id], r.run_words) & grams(items[r.item_id], r.run_words) and not grams(documents[r.doc_id], r.run_words + 1) & grams(items[r.item_id], r.run_words + 1)


def test_spliced_segments_equal_a_whole_rewrite():
    """Whatever the mix of scripts, marks, blanks and invisible characters: only segments are normalised, as if the whole text were."""
    import random

    rng = random.Random(1)
    letters = "aeocxyABKnqж и йéёλοαι ОТ\u0301\u0308\u0306\u200b\u00a0\r\n\t1≠ａ\u1100\u1161\u11a8각"
    for _ in range(20_000):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(1, 14)))
        assert textform.canonical(text) == textform._segment(text, "")[0], ascii(text)


def test_quick_check_passes_stable_text():
    check = textform._quick_check()
    for text in ("so a cat is as good as none", "Обычный текст без единого предлога", "x = 1; y := [2, 3]\n", "naïveté, Größe, señor", "日本語"):
        assert not check.search(text) or textform.canonical(text) == text
    assert not check.search("Обычный текст") and not check.search("Größe hier")


def test_hot_class_of_equal_copies(spark):
    """Equal copies never meet: 3000 of one text and one other spelling give 3000 pairs, not millions of comparisons."""
    rows = spark.range(3001).select(F.concat(F.lit("i"), "id").alias("id"), F.when(F.col("id") == 7, "кoт").otherwise("кот").alias("current"))
    got = textform.same_look_pairs(rows, "id", "current").collect()
    assert len(got) == 3000 and all("i7" in (r.id_a, r.id_b) and r.id_a < r.id_b for r in got)


def test_more_people_than_a_task_takes(spark, monkeypatch):
    """Above the bound of the table in every task the words are joined with the persons, with the same result."""
    names = ["Orlin Lane", "Горян Уляркин", "Caspar-Lo Branch", "Лучезар Ярмуский", "Single", None]
    texts = [t for t, _ in TEXTS] + ["", None, "ask O. Lane; Orlin K. Lane; O.K. Lane", "LANE, ORLIN\u200b и Горяну Уляркину", "Горян Лейн", "lane"]
    rows = spark.createDataFrame([(f"r{i}", t) for i, t in enumerate([*texts, *texts])], "record_id string, content string")
    people = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "full_name string, person_id int")
    plain = lambda: sorted((r.record_id, str(r.content), tuple(r.pii_types)) for r in pii.redacted(rows, people).collect())
    want = plain()
    monkeypatch.setattr(pii, "MAX_PEOPLE", 2)
    assert plain() == want and sum("person" in kinds for _, _, kinds in want) >= 8
    assert pii.redacted(rows.limit(0), people).count() == 0
