"""A word that lacks the letters of all terms is settled at the trie's root, and one core of many words is walked once."""

import sys

from tallyspark.llm import toxicity


def walked(call) -> int:
    """How many nodes a call's walks take up."""
    n = 0

    def count(frame, event, what):
        nonlocal n
        n += event == "c_call" and what.__name__ == "pop" and frame.f_code.co_name == "near"

    sys.setprofile(count)
    try:
        call()
    finally:
        sys.setprofile(None)
    return n


def test_words_that_lack_the_letters_are_not_walked():
    trie = toxicity.Trie({"worthless": 1.0, "garbage": 1.0}, {"scumba": 1.0})
    assert walked(lambda: [trie.near(w) for w in ("tionhee", "intended", "whitened")]) == 3  # the root of each
    assert trie.near("worhtlass") == ("worthless", 2) and trie.near("scuxpxg") is None and trie.near("scumpag") == ("scumba", 1) and trie.near("scumbbags") == ("scumba", 1)


def test_a_core_is_weighed_once():
    s = toxicity.Scorer(toxicity.Lexicon({"worthless": 1.0}))
    one = walked(lambda: s.look({"worthlexxs"}))
    assert one and walked(lambda: s.look({"worthlexxs.", '"worthlexxs', "worthlexxs!?"})) == 0
    assert s.score("so worthless, (worthless) worthless.")[1] == 3
