"""Language ID, toxicity, decontamination and chat formatting."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tamis.llm import chat_format, decontamination, language_id, toxicity

from .conftest import EDGE

SF = "/root/testdata/sf0.01"


def test_gradients_against_differences():
    net = language_id.ByteBiGru(["a", "b", "c"])
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    rng = np.random.default_rng(0)
    x, y = rng.integers(97, 110, (5, 6)), rng.integers(0, 3, 5)
    _, g = net.gradients(x, y)
    for name, v in net.p.items():
        for _ in range(4):
            at = tuple(rng.integers(0, n) for n in v.shape)
            if name == "E":
                at = (int(x[0, 0]), at[1])
            old, eps = v[at], 1e-3
            v[at] = old + eps
            up, _ = net.gradients(x, y)
            v[at] = old - eps
            down, _ = net.gradients(x, y)
            v[at] = old
            assert abs((up - down) / (2 * eps) - g[name][at]) < 2e-3


def test_label_equals_forward():
    net = language_id.ByteBiGru(["a", "b", "c"])
    ids = np.random.default_rng(1).integers(0, 256, (7, 30)) * (np.random.default_rng(3).random((7, 30)) < 0.9)
    assert np.abs(net.label(ids.T).transpose(1, 0, 2) - net.forward(ids)[0]).max() < 1e-5


def test_gradients_of_marked_positions():
    net = language_id.ByteBiGru(["a", "b"])
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    rng = np.random.default_rng(2)
    x, y, mark = rng.integers(97, 110, (4, 6)), rng.integers(0, 2, 4), rng.random((4, 6)) < 0.6
    x[1, 2] = x[3, 5] = 0
    loss, g = net.gradients(x, y, mark)
    assert abs(loss + np.log(net.forward(x)[0][np.arange(4), :, y] + 1e-9)[mark].mean()) < 1e-9
    v = net.p["Whb"]
    v[2, 3] += 1e-4
    up, _ = net.gradients(x, y, mark)
    v[2, 3] -= 2e-4
    down, _ = net.gradients(x, y, mark)
    assert abs((up - down) / 2e-4 - g["Whb"][2, 3]) < 1e-4


def test_documents_pool_their_letters():
    """Windows with their contexts, and means over letters, against one window at a time."""
    net = language_id.ByteBiGru(["a", "b", "c"])
    texts = ["m²", "x", "Éa 12 漢字! " * 90, "9 8 7", "word " * 200]
    mean, count = net.pool(texts)
    for text, m, n in zip(texts, mean, count):
        raw, letter = language_id.bytes_of(text)
        assert n == letter.sum() == sum(len(c.encode()) for c in text.lower() if c.isalpha())
        total = np.zeros(3)
        for at in range(0, len(raw), language_id.CORE):
            window = np.zeros(language_id.CORE + 2 * language_id.CONTEXT, np.uint8)
            lo, hi = max(0, at - language_id.CONTEXT), min(len(raw), at + language_id.CORE + language_id.CONTEXT)
            window[lo - at + language_id.CONTEXT : hi - at + language_id.CONTEXT] = raw[lo:hi]
            prob = net.forward(window[None].astype(int))[0][0][language_id.CONTEXT : -language_id.CONTEXT]
            mark = letter[at : at + language_id.CORE]
            total += prob[: len(mark)][mark].sum(axis=0)
        assert np.abs(m - total / max(1, n)).max() < 1e-4
    assert [p[0] == "und" for p in net.predict([*texts, None, ""])] == [False, False, False, True, False, True, True]


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = language_id.op8_language_id(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert held and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    assert sum(r["lang"] == r["lang_pred"] for r in held) / len(held) > 0.97 and all(0 <= r["score"] <= 1 for r in rows)


def test_language_edges(spark, make_docs):
    rows = [(100 + i, "the house is there " * 5, "en") for i in range(30)] + [(200 + i, "das haus ist dort " * 5, "de") for i in range(30)] + EDGE + [(300, "123 !!!"), (301, "m²")]
    got = {(r["doc_id"], r["lang_pred"]) for r in language_id.identify(make_docs(rows)).collect()}
    for i in (2, 3, 4, 300):
        assert (i, "und") in got
    assert (301, "und") not in got
    assert sum(1 for i in range(30) if (100 + i, "en") in got) > 27 and sum(1 for i in range(30) if (200 + i, "de") in got) > 27
    kept = language_id.keep_identified(make_docs(rows))
    assert kept.columns == make_docs(rows).columns and not {2, 3, 4, 300} & {r["doc_id"] for r in kept.collect()}


def test_language_untrained(spark, make_docs):
    assert language_id.identify(make_docs([])).collect() == []
    assert {r["lang_pred"] for r in language_id.identify(make_docs([(1, "abc", None)])).collect()} == {"und"}


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = _next(row, i, x, b)
    return row[-1]


def _next(prev, i, x, b):
    row = [i]
    for j, y in enumerate(b, 1):
        row.append(min(prev[j] + 1, row[-1] + 1, prev[j - 1] + (x != y)))
    return row


def test_automaton_against_distance():
    terms = ["idiot", "worthless", "pathetic", "abcd", "stem*"]
    automaton = toxicity.LexiconAutomaton(terms)
    rng = random.Random(3)
    alphabet = "abcdeiotwrhlsp"
    for _ in range(3000):
        w = list(rng.choice(terms[:4]))
        for _ in range(rng.randrange(0, 4)):
            at = rng.randrange(len(w) + 1)
            w[at : at + rng.randrange(0, 2)] = rng.choice(alphabet) * rng.randrange(0, 2)
        w = "".join(w)
        if w.startswith("stem"):
            continue
        near = [(d, k) for k, t in enumerate(terms[:4]) if (d := plain_distance(w, t)) <= toxicity.edits_for(t)]
        found = automaton.match(w)
        assert (found is None) == (not near) and (found is None or found[1] == min(near)[0]), w
    assert automaton.match("stemming") == (4, 0) and automaton.match("ste") is None


def test_automaton_forgets_states(monkeypatch):
    terms = ["idiot", "worthless", "pathetic"]
    words = ["idoit", "wortless", "patetic", "lamp", "idiots", "worthles"] * 3
    whole = [toxicity.LexiconAutomaton(terms).match(w) for w in words]
    monkeypatch.setattr(toxicity, "MAX_STATES", 3)
    automaton = toxicity.LexiconAutomaton(terms)
    assert [automaton.match(w) for w in words] == whole


def toxic_rows(n=240):
    rng = random.Random(11)
    rows, labels = [], []
    for i in range(n):
        w = [f"{rng.choice('abcdefgh')}{rng.choice('aeiou')}{rng.choice('klmnrst')}{rng.randrange(30)}" for _ in range(60)]
        bad = i % 5 == 0
        for _ in range(4 * bad):
            w.insert(rng.randrange(len(w)), rng.choice(["idiot", "worthless", "moron"]))
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(bad)))
    return rows, labels


def test_toxicity(spark, make_docs):
    rows, labels = toxic_rows()
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    extra = [(900, "well idioot you are a wortless morron idiott here"), (901, "nothing bad in this one"), (902, None), (903, ""), (None, "idiot")]
    docs = make_docs(rows + extra)
    model = toxicity.train(docs, lab)
    assert {"idiot", "worthless", "moron"} <= set(model.terms)
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    assert all(got[i]["predicted"] == t for i, _, t in labels)
    assert got[900]["predicted"] == 1 and not any(got[i]["predicted"] for i in (901, 902, 903))
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, *_ in labels)


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_toxicity_held_out(spark, sf):
    d = f"/root/testdata/{sf}"
    rows = toxicity.op7_toxicity(spark, d).filter("held_out").join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").collect()
    toxic, found = [r for r in rows if r["toxic"]], [r for r in rows if r["predicted"]]
    assert sum(r["predicted"] for r in toxic) >= 0.9 * len(toxic)
    assert sum(r["toxic"] for r in found) >= 0.9 * len(found) and all(0 <= r["score"] <= 1 for r in rows)


def test_toxicity_reads_whole_long_texts(spark, make_docs):
    rows, labels = toxic_rows()
    model = toxicity.train(make_docs(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    long = "bag lamp " * 60_000
    got = {r["doc_id"]: r["score"] for r in toxicity.score(make_docs([(1, long), (2, long + "idiot worthless moron " * 20)]), model).collect()}
    assert got[2] > got[1]


def test_quotation_lowers_abuse():
    m = toxicity.Matcher(["idiot"])
    plain, quoted = m.features("he is an idiot and more of it"), m.features('they said "what an idiot" and more of it')
    assert plain[1] > quoted[1] and quoted[2] > plain[2]


def test_toxicity_without_labels(spark, make_docs):
    docs = make_docs(EDGE)
    model = toxicity.train(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    got = toxicity.score(docs, model).collect()
    assert len(got) == len(EDGE) and not any(r["predicted"] for r in got)
    assert toxicity.score(make_docs([]), model).collect() == []


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_contamination(rows, bench):
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    windows = {}
    for i, t in bench:
        w = WORD.findall(low(t))
        for k in range(max(1, len(w) - 12) if w else 0):
            windows.setdefault(tuple(w[k : k + 13]), set()).add(str(i))
    out = []
    for r in rows:
        w, hit, items = WORD.findall(low(r[1])), set(), set()
        for n in {len(k) for k in windows}:
            for k in range(len(w) - n + 1):
                own = windows.get(tuple(w[k : k + n]))
                if own:
                    items |= own
                    hit.update(range(k, k + n))
        out.append((r[0] is None, r[0] or 0, len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out)


@pytest.mark.parametrize("block", [4 << 20, 200])
def test_decontamination(spark, make_docs, block):
    rng = random.Random(6)
    vocabulary = [f"v{i}" for i in range(12)]
    bench = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 3, 12, 13, 14, 40])))) for i in range(15)] + [(50, None), (51, ""), (52, "...!"), (2, "AbC déf 12")]
    rows = []
    for i in range(60):
        parts = [rng.choice(vocabulary) for _ in range(rng.randrange(0, 120))]
        if i % 3 == 0:
            at = rng.randrange(len(parts) + 1)
            parts[at:at] = (bench[rng.randrange(15)][1]).upper().split()
        rows.append((i, ", ".join(parts)))
    rows += EDGE + [(77, "zz abc-DÉF abc déf 12")]
    b = spark.createDataFrame(bench, "item_id long, text string")
    docs = make_docs(rows).select(F.col("doc_id"), F.col("text"), F.col("spans"))
    done = decontamination.verdict(decontamination.scan(docs.select("doc_id", "text"), b, block_bytes=block))
    got = done.select("doc_id", "n_words", "n_hit", F.size("items").alias("k"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("h"), "contaminated").collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_words"], r["n_hit"], r["k"], r["h"], r["contaminated"]) for r in got) == plain_contamination(rows, bench)
    kept = decontamination.drop_contaminated(make_docs(rows), b)
    assert kept.columns == make_docs(rows).columns
    assert kept.count() == sum(not r[-1] for r in plain_contamination(rows, bench))


def test_decontamination_empty(spark, make_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    got = decontamination.decontaminate(make_docs(EDGE), none).collect()
    assert len(got) == len(EDGE) and not any(r["contaminated"] for r in got)
    assert decontamination.decontaminate(make_docs([]), none).collect() == []


def test_items_without_ids(spark, make_docs):
    text = " ".join(f"w{i}" for i in range(13))
    bench = spark.createDataFrame([(None, text), (None, None), (5, text)], "item_id long, text string")
    (r,) = decontamination.decontaminate(make_docs([(1, text)]), bench).collect()
    assert (r["n_items"], r["n_hit"], r["items_sha256"]) == (2, 13, hashlib.sha256(b",5").hexdigest())


def test_fm_index_counts():
    rng = np.random.default_rng(2)
    text = rng.integers(0, 4, 400).astype(np.int32)
    text[-1] = 0
    index = decontamination.FmIndex(text, 3)
    for n in (1, 2, 3, 5):
        words = rng.integers(1, 4, (30, n)).astype(np.int32)
        low, high = index.search(words, np.full(30, n))
        for p, a, b in zip(words, low, high):
            places = [i for i in range(len(text) - n + 1) if (text[i : i + n] == p).all()]
            assert sorted(index.locate(np.arange(a, max(a, b))).tolist()) == places


def test_chat_roles_without_markers(spark):
    rows = []
    for c in range(60):
        rows.append((c, 0, "user", f"what is the way to thing {c}?"))
        for t in range(1, 6):
            rows.append((c, t, "assistant" if t % 2 else "user", ("a long answer with many words " * 8 + "\nand a line") if t % 2 else "and then what?"))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    hidden = df.withColumn("role", F.when((F.col("conv_id") + F.col("turn")) % 3 != 0, F.col("role")))
    got = {(r["conv_id"], r["turn"]): r for r in chat_format.format_turns(hidden).collect()}
    assert len(got) == len(rows) and sum(got[c, t]["role"] == role for c, t, role, _ in rows) / len(rows) > 0.97
    assert got[0, 0]["rendered"] == "<|im_start|>user\nwhat is the way to thing 0?<|im_end|>\n"


def some_model(seed=1):
    k = len(chat_format.ROLES)
    g = np.random.default_rng(seed)
    shape = (k, chat_format.N_MARKERS, chat_format.N_LENGTHS, chat_format.N_ASKS, chat_format.N_LINES)
    return chat_format.RoleModel.fit(g.random(k), g.random((k, k)), g.random(shape) * 50)


@pytest.mark.parametrize("fan", [1024, 3])
def test_chat_ranges_equal_one_pass(spark, fan):
    rng = random.Random(1)
    rows = [(rng.choice([1, 1, 1, 2, 3]), i, i, rng.randrange(0, chat_format.N_OBS)) for i in range(400)]
    model = some_model()
    got = chat_format.decode(spark.createDataFrame(rows, "conv long, turn long, tie long, obs int"), model, range_lines=13, fan=fan).collect()
    assert len(got) == len(rows)
    for c in (1, 2, 3):
        own = [r for r in rows if r[0] == c]
        assert [r["found"] for r in sorted(got, key=lambda r: r["turn"]) if r["conv"] == c] == model.viterbi(np.array([r[3] for r in own])).tolist()


def test_viterbi_against_all_paths():
    import itertools

    model, rng = some_model(5), np.random.default_rng(6)
    for n in (1, 2, 5):
        obs = rng.integers(0, chat_format.N_OBS * 2, n)

        def score(path):
            out = model.first[path[0]] + model.emit[path[0], obs[0]]
            for a, b, o in zip(path, path[1:], obs[1:]):
                out += model.moves[a, b] + model.emit[b, o]
            return out

        best = max(itertools.product(range(3), repeat=n), key=score)
        assert model.viterbi(obs).tolist() == list(best)


def test_chat_recovers_hidden_roles(spark):
    """Held-out conversations of the test set hold no markers; roles come from lines and turns alone."""
    rows = chat_format.op1_chat_format(spark, SF).collect()
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == spark.read.parquet(f"{SF}/conversations.parquet").count() and held
    assert all(r["held_out"] == (zlib.crc32(str(r["conv_id"]).encode()) % 4 == 2) for r in rows)
    assert sum(r["role"] == r["given_role"] for r in held) / len(held) >= 0.9
    assert all(r["marker_role"] is None for r in rows)


def test_chat_hidden_roles_are_not_seen(spark):
    docs = spark.read.parquet(f"{SF}/conversations.parquet")
    held = F.crc32(F.col("conv_id").cast("string")) % 4 == 2
    wrong = docs.withColumn("role", F.when(held, F.lit("system")).otherwise(F.col("role")))
    one, two = (sorted(chat_format.format_turns(d, hide_roles=True, holdout=(4, 2)).select("conv_id", "turn", "role", "rendered").collect()) for d in (docs, wrong))
    assert one == two


def test_chat_rendering_keeps_text(spark):
    rows = [(1, 0, "user", "System: Windows 11"), (1, 1, "assistant", "Answer: 42"), (1, 2, "user", "AI"), (1, 3, "assistant", "User: and Assistant: both")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["turn"]: r for r in chat_format.format_turns(df).collect()}
    for _, t, role, text in rows:
        assert got[t]["role"] == got[t]["given_role"] == role and got[t]["rendered"] == f"<|im_start|>{role}\n{text}<|im_end|>\n"
    lines = spark.createDataFrame([(1, 0, "User: is it Answer: 42?"), (1, 1, "AI"), (1, 2, "Assistant: yes")], "conv_id long, turn long, text string")
    got = {r["turn"]: r["rendered"] for r in chat_format.format_turns(lines, role_col=None).collect()}
    assert "\nis it Answer: 42?<" in got[0] and "\nAI<" in got[1] and "\nyes<" in got[2]


def test_chat_transcripts_and_edges(spark):
    t = spark.createDataFrame([(1, "System: be kind\nUser: hi?\nAssistant: hello there\nand more"), (2, None), (3, "")], "id long, body string")
    lines = chat_format.transcript_lines(t, "id", "body")
    got = {(r["conv_id"], r["turn"]): r for r in chat_format.format_turns(lines, role_col=None).collect()}
    assert [got[1, i]["marker_role"] for i in range(4)] == ["system", "user", "assistant", None]
    assert got[1, 2]["rendered"] == "<|im_start|>assistant\nhello there<|im_end|>\n" and len(got) == 6
    odd = spark.createDataFrame([(None, None, None, None), (1, 0, "weird", "x"), (1, 0, "weird", "x"), (1, None, "user", "y")], "conv_id long, turn long, role string, text string")
    assert chat_format.format_turns(odd.withColumn("obs", F.lit(1)).withColumn("tie", F.lit(2))).count() == 4
    assert chat_format.format_turns(odd.limit(0)).collect() == []
