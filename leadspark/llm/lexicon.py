"""A lexicon trie and the Levenshtein automaton that walks it.

The trie holds stems and weak stems, which match every word that begins with them, and whole terms. Words may
differ from terms and from longer stems by the allowed number of edits. The automaton runs over all of them at once; a state is the
set of (trie node, edits) pairs that a word's letters so far can reach. States and moves are made
when first met and kept, and most words reach the empty state after three or four letters. A second
automaton allows the edit at the first letter too; its states live longer, so it is asked only about
words that the first one does not match, and about whole terms only. Terms under five letters, stems under six and weak
stems get no edits: too many everyday words are one letter away from them.
"""

from __future__ import annotations

import re

_EDGES = re.compile(r"^[\W_]+|[\W_]+$")
NO_MATCH = 0
EXACT, FUZZY, FIRST, WEAK, FUZZY_STEM = 1, 2, 3, 4, 5


class LexiconTrie:
    def __init__(self, stems: list[str], terms: list[str] = (), weak: list[str] = ()) -> None:
        self.children: list[dict[str, int]] = [{}]
        self.length: list[int] = [0]
        self.stems = {self._add(stem) for stem in sorted(stems)}
        self.terms = {self._add(term) for term in sorted(terms)}
        self.weak = {self._add(stem) for stem in sorted(weak)}

    def _add(self, word: str) -> int:
        node = 0
        for ch in word:
            if ch not in self.children[node]:
                self.children[node][ch] = len(self.children)
                self.children.append({})
                self.length.append(self.length[node] + 1)
            node = self.children[node][ch]
        return node


class LevenshteinAutomaton:
    """Deterministic matcher of words against a trie, with edits allowed in longer whole terms."""

    def __init__(self, trie: LexiconTrie, edits: int = 1, least_fuzzy: int = 5, first_letter: bool = False, least_stem: int = 6) -> None:
        self.trie, self.edits, self.least, self.first_letter, self.least_stem = trie, edits, least_fuzzy, first_letter, least_stem
        self.names: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.begins: list[bool] = []
        self.passed: list[int] = []
        self.ends: list[int] = []
        self.moves: dict[tuple[int, str], int] = {}
        self.start = self._state(self._closed({(0, 0)}))

    def _closed(self, pairs: set[tuple[int, int]]) -> frozenset:
        """Add the states that leaving out letters of the term reaches; keep the fewest edits a node."""
        best: dict[int, int] = {}
        todo = list(pairs)
        while todo:
            node, e = todo.pop()
            if best.get(node, self.edits + 1) <= e:
                continue
            best[node] = e
            # Edits of the first letter are for the second automaton, or every word would begin a match.
            if e < self.edits and (node or self.first_letter):
                todo += [(child, e + 1) for child in self.trie.children[node].values()]
        return frozenset(best.items())

    def _state(self, pairs: frozenset) -> int:
        if pairs not in self.names:
            self.names[pairs] = len(self.sets)
            self.sets.append(pairs)
            self.begins.append(any(e == 0 and node in self.trie.stems for node, e in pairs))
            weak = any(e == 0 and node in self.trie.weak for node, e in pairs)
            near = any(node in self.trie.stems and self.trie.length[node] >= self.least_stem for node, e in pairs)
            self.passed.append(WEAK if weak else FUZZY_STEM if near else NO_MATCH)
            ends = [e for node, e in pairs if node in self.trie.terms and (e == 0 or self.trie.length[node] >= self.least)]
            self.ends.append(NO_MATCH if not ends else EXACT if min(ends) == 0 else FUZZY)
        return self.names[pairs]

    def _move(self, state: int, ch: str) -> int:
        out: set[tuple[int, int]] = set()
        for node, e in self.sets[state]:
            for letter, child in self.trie.children[node].items():
                if letter == ch:
                    out.add((child, e))
                elif e < self.edits and (node or self.first_letter):
                    out.add((child, e + 1))
            if e < self.edits and (node or self.first_letter):
                out.add((node, e + 1))
        key = (state, ch)
        self.moves[key] = self._state(self._closed(out))
        return self.moves[key]

    def match(self, word: str) -> int:
        """Kind of the best match: a whole stem or term, a misspelled term, a weak stem, a misspelled stem."""
        state, passed = self.start, NO_MATCH
        for ch in word:
            state = self.moves[state, ch] if (state, ch) in self.moves else self._move(state, ch)
            if self.begins[state]:
                return EXACT
            if self.passed[state] and passed != WEAK:
                passed = self.passed[state]
            if not self.sets[state]:
                return passed
        return self.ends[state] or passed


class WordMatcher(dict):
    """Match kind of every raw token, kept for the next time; bounded."""

    def __init__(self, automaton: LevenshteinAutomaton, most: int = 300_000) -> None:
        super().__init__()
        self.automaton, self.most = automaton, most
        self.second = LevenshteinAutomaton(automaton.trie, automaton.edits, automaton.least, True)

    def __missing__(self, token: str) -> int:
        if len(self) >= self.most:
            self.clear()
        word = _EDGES.sub("", token)
        kind = self.automaton.match(word)
        if not kind and self.second.match(word) in (EXACT, FUZZY):
            kind = FIRST
        self[token] = kind
        return kind
