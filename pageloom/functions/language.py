"""A character n-gram model, and how fluent and grammatical a text looks."""

from __future__ import annotations

import math
import string
from collections import Counter
from functools import cache

from .native import MISREAD

# Characters of the model, their number, its orders' weights (index 0: single characters) and the weight of a uniform draw.
LETTERS = set(string.ascii_lowercase + " .,;:!?'\"-()\n")
VOCABULARY = 45
WEIGHTS = (0.60, 0.20, 0.10, 0.07)
UNIFORM = 0.03
START, END = "<s>", "</s>"

#: A short English text of our own; any other can be passed.
CORPUS = """
the morning train was late again, so we walked along the river and talked about the week. nobody had slept well, but the air
was clear and the light on the water made up for it. at the old mill we stopped to read the notice on the door. it said that the
building would be restored in the spring, and that visitors were welcome to see the plans. inside, an engineer showed us how
the wheel once turned the stones, and how the grain was carried up to the loft. she spoke slowly and answered every question.
when a page is read by a machine, some letters are taken for others. a good reader looks at the whole word, and at the words on
either side, before deciding what was written. that is why a clean copy reads easily, while a poor one has to be guessed. we
compare what was read with what was meant, count the differences, and report how many there were for each hundred letters.
the report is short. it gives the name of each system, the number of pages, and the rate of errors. people who use it want to know
which system to choose, how sure they can be, and where the errors come from. some come from noise in the picture, others from
tables, narrow columns or writing by hand. after lunch the children ran ahead to the bridge. there is a story that the bridge was
built in a single night, but the stones tell us it took many years. we think both are true in their own way, because someone must
have begun it one evening with the first stone. in the end we reached the village, where the market was closing and the last
apples were sold for almost nothing. the way home was longer than we thought, and it was dark when we came to the gate.
"""

#: The hundred operations of C. K. Ogden's Basic English (1930), the words that carry its grammar; any other list can be passed.
COMMON = frozenset("""
come get give go keep let make put seem take be do have say see send may will
about across after against among at before between by down from in off on over through to under up with
as for of till than
a the all any every little much no other some such that this I he you who
and because but or if though while
how when where why
again ever far forward here near now out still then there together well
almost enough even not only quite so very tomorrow yesterday north south east west please yes
""".lower().split())


class CharModel:
    """Counts of runs of up to n characters."""

    def __init__(self, corpus: str = CORPUS, n: int = 4, weights: tuple[float, ...] = WEIGHTS):
        self.n, self.weights = n, weights
        clean = "".join(c if c in LETTERS else " " for c in corpus)
        items = [START] * (n - 1) + list(clean) + [END]
        self.runs: list[Counter] = [Counter() for _ in range(n)]
        self.before: list[Counter] = [Counter() for _ in range(n)]
        for i in range(n - 1, len(items)):
            for k in range(n):
                history = "".join(items[i - k : i])
                self.runs[k][history + items[i]] += 1
                self.before[k][history] += 1

    def log_probability(self, item: str, history: str) -> float:
        p = UNIFORM / VOCABULARY
        for k in range(self.n):
            # Histories are cut by characters: the mark of the start counts as several.
            h = history[-k:] if k else ""
            seen = self.before[k].get(h, 0) if len(h) == k else 0
            if seen:
                p += self.weights[k] * self.runs[k].get(h + item, 0) / seen
        return math.log(max(p, 1e-30))

    def perplexity(self, text: str) -> float:
        if not text:
            return 1000.0
        items = [START] * (self.n - 1) + list(text) + [END]
        total = 0.0
        for i in range(self.n - 1, len(items)):
            total += self.log_probability(items[i], "".join(items[i - self.n + 1 : i])[-(self.n - 1) :])
        return math.exp(-total / (len(items) - self.n + 1))


@cache
def model() -> CharModel:
    return CharModel()


def fluency(text: str, of: CharModel | None = None) -> float:
    """1 for a perplexity of 1, 0 for that of a uniform draw; digits count as the letters that they are misread from."""
    if not text or text.isspace():
        return 0.0
    ppl = (of or model()).perplexity(text.lower().translate(str.maketrans(*MISREAD)))
    return min(1.0, max(0.0, 1 - (ppl - 1) / (VOCABULARY - 1)))


def punctuation(text: str) -> float:
    """1 less the mean penalty over marks: 0.3 for a mark inside a word (by its first place there), 0.2 for a full stop,
    exclamation or question mark, or comma, that no blank follows. Without marks, one half."""
    lost, seen = 0.0, 0
    for token in text.split():
        inner = [i for i, c in enumerate(token) if c.isalnum()]
        outer = token.strip(string.punctuation)
        if len(outer) == len(token):
            continue
        for c in token:
            if c in string.punctuation:
                seen += 1
                if c in ",.!?:;'\"" and inner and inner[0] < token.find(c) < inner[-1]:
                    lost += 0.3
    for i, c in enumerate(text):
        if c in ".!?,":
            seen += 1
            if i + 1 < len(text) and text[i + 1] not in " \n\r\t":
                lost += 0.2
    return max(0.0, 1 - lost / seen) if seen else 0.5


def grammaticality(text: str, common: frozenset[str] = COMMON) -> float:
    """0.40 share of common words + 0.25 usual word length + 0.20 punctuation + 0.15 share of vowels."""
    tokens = text.split() if text else []
    if not tokens:
        return 0.0
    known = sum(t.lower().strip(string.punctuation) in common for t in tokens) / len(tokens)
    sizes = [len(t) for t in tokens if any(c.isalpha() for c in t)]
    length = max(0.0, 1 - abs(sum(sizes) / len(sizes) - 5) / 5) if sizes else 0.0
    letters = [c for c in text.lower() if c in string.ascii_lowercase]
    vowels = max(0.0, 1 - abs(sum(c in "aeiou" for c in letters) / len(letters) - 0.38) / 0.38) if letters else 0.0
    return min(1.0, 0.40 * known + 0.25 * length + 0.20 * punctuation(text) + 0.15 * vowels)


def plausibility(text: str) -> float:
    return 0.6 * fluency(text) + 0.4 * grammaticality(text) if text and not text.isspace() else 0.0
