"""Broken prompt and response pairs: empty, refusing, copying, cut off, or in another language.

For each pair a suffix automaton of the prompt's words is traversed with the response's words, which
gives the share of the response that is copied from the prompt and what follows the last copied run.
A phrase automaton finds refusals, a stack of delimiters and the last character find cut responses, and
stopword votes give the languages of both sides. A pair has at most one defect: the first of empty,
refusal, copied_question, other_language, truncated that holds.

Defined results: a null response is empty; a null prompt leaves only defects that need no prompt; bare
values have no language and are never cut; rows delivered twice give one row; texts are read whole.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame

# Texts without content.
NO_CONTENT = {"null", "none given", "n/a", "na", "nan", "nil", "tbd", "tba", "blank", "empty", "no answer", "not answered", "undefined", "answer", "response", "a"}
# Phrases of declining and of not finding, in words; one of them makes a response a refusal.
REFUSALS = """
unable to answer | unable to respond | unable to help | not able to answer | not able to give | not able to provide | not able to help
cannot answer | can not answer | can t answer | cannot be answered | cannot be determined | cannot determine | can t determine | could not determine | cannot provide | can t provide | can t help | cannot help | won t be able to
not possible to answer | not possible to say | not possible to determine | impossible to answer | impossible to say
not found in the provided | not found in the given | not found in the context | not found in the documents | could not be found in | cannot be found in | not available in the provided | not mentioned in the | not stated in the provided | not specified in the provided
no information on | no information about | no relevant information | insufficient context | insufficient information | not enough information | not enough context | don t have enough | do not have enough | no answer could be | no answer is given | no answer can be
must decline | i decline | have to decline | would rather not | prefer not to answer | i refuse | will not answer | won t answer | won t speculate | will not speculate | rather not guess | outside of what i may | outside what i may | not allowed to | as a language assistant | as a language model | as an ai | my apologies | i apologize | i apologise
does not say anything about | do not say anything about | says nothing about | say nothing about | is silent about | are silent about | is silent on | does not specify this | does not contain | do not contain | does not mention | do not mention | does not provide | do not provide | does not include any
nothing in the passages | nothing in the context | nothing in the excerpts | nothing in the documents | nothing in the sources | nothing in the text | nothing here allows
question stays open | question remains open | stays unanswered | remains unanswered | left unanswered | is left open | no way to tell | no way of knowing | no way to know | hard to say | could not say | cannot say | can t say | can t tell | cannot tell | can t answer that | i don t know | i do not know | not sure | sorry i | sorry but | i m sorry | i am sorry | we are sorry | i m afraid | i am afraid
kann ich nicht beantworten | kann nicht beantwortet werden | keine angabe | keine informationen | nicht gefunden | geht aus dem kontext nicht hervor | leider kann ich | tut mir leid
je ne peux pas | ne peut pas être déterminé | aucune information | introuvable dans | impossible de répondre | je suis désolé | désolé je
no puedo responder | no se puede determinar | no se encuentra en | no hay información | lo siento | no es posible responder
"""
# Function words that vote for a language (articles, pronouns, prepositions, conjunctions, auxiliaries, particles).
STOPWORDS = {
    "en": "the a an of and or but if is are was were be been to in into with for by from at on as that this these those which what who when where why how do does did it its they their we our you your i not no has have had can could may might must should will would there than then so only also about between after before during under over because until while each any all some such more most other",
    "de": "der die das den dem des ein eine einen einem einer eines und oder aber wenn als ob dass weil ist sind war waren wird werden wurde wurden hat haben hatte kann können muss müssen soll darf nicht kein keine nur auch noch schon im in ins zu zum zur mit für von vom auf bei beim an am aus nach über unter vor durch gegen ohne um bis seit laut wie was wer wo welche welcher welches es er sie ich wir ihr man sich so sehr mehr",
    "fr": "le la les un une des du de et ou mais si est sont était été être a ont avait avoir ne pas plus que qui quoi dont où quel quelle quels quelles quand comment pourquoi ce cet cette ces il elle ils elles on nous vous je se son sa ses leur leurs au aux à en dans sur sous par pour avec sans selon entre vers chez depuis pendant après avant car donc aussi très tout toute tous même",
    "es": "el la los las un una unos unas de del y e o u pero si es son era fue ser está están estar hay ha han había que qué quien cual cuál cuando cómo donde dónde por para con sin según sobre entre hasta desde en al se su sus lo le les me te nos no ni más muy también solo sólo como porque mientras este esta estos estas ese esa todo toda todos todas",
    "it": "il lo la i gli le un uno una di del della dei delle dello degli e o ma se è sono era essere ha hanno non che chi cui quale quali quando come dove perché per con senza su sul sulla in nel nella nelle al alla alle agli da dal dalla solo anche più molto questo questa questi queste si ci ne viene finché",
    "nl": "de het een en of maar als dat die dit deze is zijn was waren wordt worden werd heeft hebben niet geen van voor met op in aan bij uit naar over onder door tegen zonder om tot naast alleen ook nog al wie wat waar hoe welke er je we ze ik hij zij hun dan zo zolang te",
    "pt": "o a os as um uma uns umas de do da dos das e ou mas se é são era foi ser está estão há não que quem qual quais quando como onde porque por para pelo pela com sem sobre entre até desde em no na nos nas ao à às só também mais muito este esta esse essa seu sua enquanto",
    "sv": "en ett den det de och eller men om som är var vara har hade inte på i med för av till från under över vid efter före genom utan bara också vad vem när var hur vilken så länge står",
    "da": "en et den det de og eller men hvis som er var være har havde ikke på i med for af til fra under over ved efter før gennem uden kun også hvad hvem når hvor hvordan så længe står",
    "no": "en et ei den det de og eller men hvis som er var være har hadde ikke på i med for av til fra under over ved etter før gjennom uten bare også hva hvem når hvor hvordan så lenge står",
    "pl": "i a w we na do z ze o od po za nie się jest są był była być to ten ta te że który która które oraz lub ale jak gdy gdzie tylko też przez przy dla pod nad bez przed dopóki",
    "cs": "a i v ve na do z ze o od po za ne se je jsou byl byla být to ten ta že který která které nebo ale jak když kde jen také při pro pod nad bez před dokud",
    "fi": "ja on ei se että tai mutta jos kun niin vain myös ovat oli olla ole hän he ne tämä joka jotka mikä missä miten kuin kanssa ilman mukaan kauan",
}
MIN_RUN = 2  # words of a run that counts as copied
COPIED = 0.75  # covered share of the response from which it is a copy
LENGTH = 0.5  # words of a copy, at least, to each word of the prompt
ANSWERED = 3  # words after the last copied run that make it an answer
NAMED = 4  # words without digits, at least, for a response to have a language
SENTENCE = 14  # words between blanks from which a response without an end is cut; from CLAUSE on if it does not end in a value
CLAUSE = 6

_WORD = re.compile(r"[^\W_]+")
_LEAD = re.compile(r"^\s*(?:(?:final\s+)?(?:answer|response|a)\s*[:\-–—]+\s*)+", re.I)
_ASKED = re.compile(r"^\s*(?:the question is|you asked|question|q|prompt)\s*[:\-–—]\s*", re.I)
_VALUE_END = re.compile(r"(?:\d[\d.,]*|\b(?:zero|one|two|three|four|five|six|seven|eight|nine|ten))\s*(?:[^\W\d_](?:[^\W\d_]|-){0,11}\.?(?:\s(?:dc|ac|m/h|per\s\w+))?|°\s?[cf]?|Ω|µa|m³/h|m3/h|cu m/h|ft³/min|l/s|[\"″%])?\s*$", re.I)
_CUT_MARK = re.compile(r"(?:…|\.\.\.)\s*(?:\[[^\]]*\]|\([^)]*\))?\s*$|\[(?:cut|truncated|…|\.\.\.)\]\s*$", re.I)
_OPEN, _CLOSE = "([{“„«", ")]}””»"


class SuffixAutomaton:
    """The suffix automaton of a sequence of words."""

    def __init__(self, words: list[str]):
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length = [-1], [0]
        last = 0
        for w in words:
            cur = len(self.next)
            self.next.append({})
            self.length.append(self.length[last] + 1)
            self.link.append(0)
            p = last
            while p != -1 and w not in self.next[p]:
                self.next[p][w] = cur
                p = self.link[p]
            if p != -1:
                q = self.next[p][w]
                if self.length[p] + 1 == self.length[q]:
                    self.link[cur] = q
                else:
                    clone = len(self.next)
                    self.next.append(dict(self.next[q]))
                    self.length.append(self.length[p] + 1)
                    self.link.append(self.link[q])
                    while p != -1 and self.next[p].get(w) == q:
                        self.next[p][w] = clone
                        p = self.link[p]
                    self.link[q] = self.link[cur] = clone
            last = cur

    def matches(self, words: list[str]) -> list[int]:
        """For each word the length of the longest run ending there that the sequence holds."""
        out, state, n = [], 0, 0
        for w in words:
            while state and w not in self.next[state]:
                state = self.link[state]
                n = self.length[state]
            if w in self.next[state]:
                state, n = self.next[state][w], n + 1
            out.append(n)
        return out


def coverage(prompt: list[str], response: list[str]) -> tuple[float, int]:
    """(share of the response's words in copied runs, words after the last such run)."""
    if not response or not prompt:
        return 0.0, len(response)
    ends = SuffixAutomaton(prompt).matches(response)
    covered, reach = 0, -1
    until = len(response)
    for i in range(len(response) - 1, -1, -1):
        if ends[i] >= MIN_RUN:
            reach = max(reach, i)
            start = i - ends[i] + 1
            covered += max(0, min(until, i + 1) - start)
            until = min(until, start)
    return covered / len(response), len(response) - 1 - reach


@lru_cache(maxsize=1)
def _refusals():
    import ahocorasick

    a = ahocorasick.Automaton()
    for phrase in re.split(r"[|\n]", REFUSALS):
        if phrase.strip():
            a.add_word(f" {phrase.strip()} ", phrase.strip())
    a.make_automaton()
    return a


_VOTES = {k: frozenset(v.split()) for k, v in STOPWORDS.items()}


def language(words: list[str]) -> tuple[str | None, int]:
    """(language with the most stopwords, its lead over English or the next); none without two votes."""
    counts = Counter(words)
    votes = {k: sum(n for w, n in counts.items() if w in v) for k, v in _VOTES.items()}
    best = max(votes, key=lambda k: votes[k])
    if votes[best] < 2:
        return None, 0
    return best, votes[best] - max(n for k, n in votes.items() if k != best)


def votes(words: list[str], lang: str) -> int:
    return sum(w in _VOTES[lang] for w in words)


def other_language(words: list[str], here: str) -> bool:
    there = language(words)[0]
    return bool(there) and there != here and votes(words, there) >= votes(words, here) + 2


def own_words(prompt: list[str], response: list[str]) -> list[str]:
    """The response's words outside the runs copied from the prompt: names taken over from it tell nothing of the response's language."""
    ends = SuffixAutomaton(prompt).matches(response)
    own = [True] * len(response)
    for i, n in enumerate(ends):
        if n >= MIN_RUN:
            own[i - n + 1 : i + 1] = [False] * n
    return [w for w, o in zip(response, own) if o]


def unclosed(text: str) -> bool:
    """Whether a bracket stays open; apostrophes and inch marks are no delimiters."""
    stack = []
    for c in text:
        if c in _OPEN:
            stack.append(_CLOSE[_OPEN.index(c)])
        elif stack and c == stack[-1]:
            stack.pop()
    return bool(stack)


def cut_off(text: str, words: list[str]) -> bool:
    """Whether a response stops before its sentence is whole."""
    t = text.rstrip()
    if _CUT_MARK.search(t) or unclosed(t):
        return True
    bare = t.rstrip("\"'”’)]»")
    if bare[-1:] in ".!?。":
        return False
    if t[-1:] in ",;:-–—(/&":
        return True
    spoken = len(t.split())
    if spoken >= SENTENCE:
        return True
    return spoken >= CLAUSE and not _VALUE_END.search(t) and t[-1:] not in ")]"


def defect(prompt: str | None, response: str | None) -> str | None:
    """The defect of one pair, or none."""
    text = _LEAD.sub("", response or "")
    words = _WORD.findall(text.lower().replace("’", "'"))
    if not words or " ".join(words) in NO_CONTENT or text.strip().lower() in NO_CONTENT:
        # Units without letters, such as a bare sign, never stand alone; signs and marks are no content.
        return "empty"
    flat = f" {' '.join(words)} "
    if next(_refusals().iter(flat), None):
        return "refusal"
    asked = _WORD.findall((prompt or "").lower().replace("’", "'"))
    given = _WORD.findall(_ASKED.sub("", text).lower().replace("’", "'"))
    if asked and len(given) >= LENGTH * len(asked):
        share, rest = coverage(asked, given)
        if share >= COPIED and rest < ANSWERED:
            return "copied_question"
    if asked and sum(not any(c.isdigit() for c in w) for w in words) >= NAMED:
        here = language(asked)[0]
        if here and (other_language(words, here) or any(votes(words, k) >= 2 for k in _VOTES if k != here) and other_language(own_words(asked, words), here)):
            return "other_language"
    if cut_off(text, words):
        return "truncated"
    return None


def find_defects(pairs: DataFrame) -> DataFrame:
    """(id, defect) of every pair with a defect."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, d) for i, q, a in zip(b["id"], b["question"], b["ground_truth"]) if i is not None and (d := defect(q, a))]
            yield pd.DataFrame(rows, columns=["id", "defect"])

    return pairs.select("id", "question", "ground_truth").mapInPandas(run, "id string, defect string").distinct()
