"""Words that a stem covers keep their own edits."""

import random

from tamis.llm import toxicity


def test_misspelled_stem():
    rng = random.Random(5)
    forms = ["grumbelor", "grumbelix", "grumbelas", "grumbelun", "grumbelet", "grumbelik"]
    texts, toxic = [], []
    for i in range(300):
        w = ["".join(rng.choice("aeiou") + rng.choice("klnrst") for _ in range(3)) for _ in range(40)]
        if i % 5 == 0:
            for k in (0, 1):
                w.insert(rng.randrange(1, len(w)), forms[(i // 5 + k) % len(forms)])
        texts.append(" ".join(w))
        toxic.append(float(i % 5 == 0))
    terms = toxicity.learn_terms(texts, toxic)
    assert any(t.endswith("*") and "grumbelor".startswith(t[:-1]) for t in terms)
    matcher = toxicity.Matcher(terms)
    assert matcher.codes(forms).tolist() == [3] * len(forms)
    assert matcher.codes(["grxmbelor", "gumbelix", "rgumbelas"]).tolist() == [2, 2, 2]
    assert matcher.codes(["gxxxbelor", "zzzzzz"]).tolist() == [0, 0]


def test_one_form_alone_is_chance():
    matcher = toxicity.Matcher(["grumbel*", "idiot"])
    one, two = matcher.features("a grumbelor and a grumbelor here"), matcher.features("a grumbelor and a grumbelix here")
    assert not one[1:].any() and two[3] > 0


def test_ordinary_neighbours_lower_edits():
    texts = [f"some idiot number {i}" for i in range(40)] + [f"an idioot here {i}" for i in range(5)] + [f"my coser is fine {i}" for i in range(300)] + [f"a loser {i}" for i in range(30)]
    toxic = [1.0] * 45 + [0.0] * 300 + [1.0] * 30
    assert toxicity.learn_edits(["idiot", "loser", "grum*"], texts, toxic) == [1, 0, 0]
