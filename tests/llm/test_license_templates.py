"""License templates: the automata against regular expressions, on expanded and on changed wordings."""

import random
import re

import pytest

from furlong.llm import license_scan as L

MARK = re.compile(r"\[\[|\]\]|\{\{.*?\}\}|\||[^\s\[\]{}|]+")


def expression(template):
    """A regular expression over words that are each followed by a blank."""
    spelt = lambda words: "".join(re.escape(w) + " " for w in words.split())
    out = ""
    for mark in MARK.findall(template):
        if mark in ("[[", "]]", "|"):
            out += {"[[": "(?:", "]]": ")?", "|": "|"}[mark]
        elif mark.startswith("{{"):
            inner = mark[2:-2]
            out += f"(?:[^ ]+ ){{0,{inner}}}" if inner.isdigit() else "(?:" + "|".join(map(spelt, inner.split("|"))) + ")"
        else:
            out += spelt(mark)
    return re.compile(out)


def expanded(template, rnd):
    """One wording of a template: options taken or left, one of each alternative, replaceable words filled."""
    marks, at = MARK.findall(template), 0

    def sequence():
        nonlocal at
        options = [[]]
        while at < len(marks) and marks[at] != "]]":
            mark = marks[at]
            at += 1
            if mark == "|":
                options.append([])
            elif mark == "[[":
                inner = sequence()
                at += 1
                options[-1] += inner if rnd.random() < 0.5 else []
            elif mark.startswith("{{"):
                inner = mark[2:-2]
                options[-1] += [f"x{rnd.randrange(9)}" for _ in range(rnd.randrange(int(inner) + 1))] if inner.isdigit() else rnd.choice(inner.split("|")).split()
            else:
                options[-1].append(mark)
        return rnd.choice(options)

    return sequence()


def changed(words, rnd):
    words, k = list(words), rnd.randrange(len(words))
    how = rnd.randrange(4)
    if how == 0:
        del words[k]
    elif how == 1:
        words.insert(k, "extra")
    elif how == 2:
        words[k] = "other"
    else:
        words.insert(k, words[k])
    return words


@pytest.mark.parametrize(("label", "template"), L.TEMPLATES)
def test_automata_equal_expressions(label, template):
    rnd, automaton, pattern = random.Random(label), dict(L.automata())[label], expression(template)
    seen = set()
    for _ in range(150):
        words = expanded(template, rnd)
        assert automaton.match(words, 0) == len(words)
        assert automaton.match(["before", *words, "after"], 1) == len(words) + 1 or pattern.match(" ".join([*words, "after "]))
        assert label in L.scan_text("Before, " + ", ".join(w.upper() for w in words) + ".")["labels"]
        for _ in range(4):
            other = changed(words, rnd)
            if other:
                whole = bool(pattern.fullmatch("".join(w + " " for w in other)))
                assert (automaton.match(other, 0) == len(other)) == whole
                seen.add(whole)
    assert False in seen
