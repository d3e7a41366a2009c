"""Edit sequences as linked nodes that share their prefixes, and a dynamic program over them.

A node is one more letter on its parent's sequence. It keeps its ancestors 1, 2, 4, ...
steps up and a rolling hash of its sequence, so two sequences compare by a search for
their longest common prefix in a logarithmic number of steps. Equal hashes are verified
by walking up to a node that both share (pairs once verified end the walk), and a
collision falls back to comparing the sequences letter by letter.
"""

from __future__ import annotations

MODULUS = (1 << 61) - 1
BASE = 911_382_323


class AuditTree:
    def __init__(self, modulus: int = MODULUS):
        self.modulus = modulus
        self.letters, self.depth, self.hash, self.up = [""], [0], [0], [[]]
        self._equal: set[tuple[int, int]] = set()

    def __len__(self) -> int:
        return len(self.letters)

    def add(self, parent: int, letter: str) -> int:
        node = len(self.letters)
        self.letters.append(letter)
        self.depth.append(self.depth[parent] + 1)
        self.hash.append((self.hash[parent] * BASE + ord(letter)) % self.modulus)
        ups, at, level = [parent], parent, 0
        while level < len(self.up[at]):
            at = self.up[at][level]
            ups.append(at)
            level += 1
        self.up.append(ups)
        return node

    def ancestor(self, node: int, depth: int) -> int:
        """The prefix of ``depth`` letters."""
        more = self.depth[node] - depth
        while more:
            level = more.bit_length() - 1
            node = self.up[node][level]
            more -= 1 << level
        return node

    def path(self, node: int, above: int = 0) -> str:
        """The letters from node ``above`` (its ancestor) down to ``node``."""
        letters = []
        while node != above:
            letters.append(self.letters[node])
            node = self.up[node][0]
        return "".join(reversed(letters))

    def _same(self, a: int, b: int) -> bool:
        """Whether two nodes of equal depth and hash hold the same sequence."""
        walked = []
        while a != b and (a, b) not in self._equal:
            if self.letters[a] != self.letters[b]:
                return False
            walked.append((a, b))
            a, b = self.up[a][0], self.up[b][0]
        self._equal.update(walked)
        return True

    def less(self, x: int, y: int) -> bool:
        """Whether the sequence of ``x`` comes before that of ``y`` (a proper prefix comes first)."""
        depth = min(self.depth[x], self.depth[y])
        a, b = self.ancestor(x, depth), self.ancestor(y, depth)
        if self.hash[a] == self.hash[b]:
            if self._same(a, b):
                return self.depth[x] < self.depth[y]
            return self.path(x) < self.path(y)
        for level in reversed(range(len(self.up[a]))):
            if level < len(self.up[a]):
                c, d = self.up[a][level], self.up[b][level]
                if self.hash[c] != self.hash[d]:
                    a, b = c, d
        if self._same(self.up[a][0], self.up[b][0]):
            return self.letters[a] < self.letters[b]
        return self.path(x) < self.path(y)

    def meeting(self, nodes: list[int]) -> int:
        """The deepest node that all ``nodes`` come from."""
        at = nodes[0]
        for other in nodes[1:]:
            depth = min(self.depth[at], self.depth[other])
            at, other = self.ancestor(at, depth), self.ancestor(other, depth)
            if at != other:
                for level in reversed(range(len(self.up[at]))):
                    if level < len(self.up[at]) and self.up[at][level] != self.up[other][level]:
                        at, other = self.up[at][level], self.up[other][level]
                at = self.up[at][0]
        return at

    def rooted(self, top: int, nodes: list[int]) -> tuple[AuditTree, list[int]]:
        """A tree of only what lies between ``top`` and ``nodes``, and where these are in it."""
        keep = set()
        for node in nodes:
            while node != top and node not in keep:
                keep.add(node)
                node = self.up[node][0]
        tree, place = AuditTree(self.modulus), {top: 0}
        for node in sorted(keep):  # parents are older than their children
            place[node] = tree.add(place[self.up[node][0]], self.letters[node])
        return tree, [place[n] for n in nodes]


# The automaton of `(s?(ua)+)?` over role initials.
START, SYSTEM, USER, ASSISTANT = range(4)
KEEPS = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
SPOKEN = {START: USER, SYSTEM: USER, ASSISTANT: USER, USER: ASSISTANT}  # what a reroled or inserted row makes of a state
NAMES = {USER: "user", ASSISTANT: "assistant"}
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1


class AuditDP:
    """The cheapest edits of a growing row sequence, least letters first among equals.

    Per state of the automaton one best (cost, node) is alive. ``settle`` returns the
    letters that all living sequences share and forgets them.
    """

    def __init__(self, modulus: int = MODULUS):
        self.tree = AuditTree(modulus)
        self.alive: dict[int, tuple[int, int]] = {START: (0, 0)}
        self._insert()

    def _offer(self, best: dict, state: int, cost: int, parent: int, letter: str) -> None:
        held = best.get(state)
        if held is None or cost < held[0]:
            best[state] = cost, self.tree.add(parent, letter)
        elif cost == held[0]:
            node = self.tree.add(parent, letter)
            if self.tree.less(node, held[1]):
                best[state] = cost, node

    def _insert(self) -> None:
        # a user turn from any other state, then an assistant turn; more inserts only cost
        for state in (START, SYSTEM, ASSISTANT):
            if state in self.alive:
                cost, node = self.alive[state]
                self._offer(self.alive, USER, cost + INSERT, node, "I")
        cost, node = self.alive[USER]
        self._offer(self.alive, ASSISTANT, cost + INSERT, node, "I")

    def feed(self, initial: str, must_go: bool, truncated: bool) -> None:
        best: dict[int, tuple[int, int]] = {}
        more = TRUNCATED if truncated else 0
        for state, (cost, node) in self.alive.items():
            self._offer(best, state, cost + DELETE, node, "D")
            if not must_go:
                kept = KEEPS.get((state, initial))
                if kept is not None:
                    self._offer(best, kept, cost + more, node, "K")
                self._offer(best, SPOKEN[state], cost + REROLE + more, node, "R")
        self.alive = best
        self._insert()
        # From the assistant state every continuation of the system state costs as much, and of the
        # start state at most a deletion more: beyond that these can't be part of a cheapest sequence.
        least = best[ASSISTANT][0]
        for state, slack in ((START, DELETE), (SYSTEM, 0)):
            if state in best and best[state][0] > least + slack:
                del best[state]

    def settle(self) -> str:
        states = list(self.alive)
        nodes = [self.alive[s][1] for s in states]
        top = self.tree.meeting(nodes)
        letters = self.tree.path(top)
        self.tree, nodes = self.tree.rooted(top, nodes)
        self.alive = {s: (self.alive[s][0], n) for s, n in zip(states, nodes)}
        return letters

    def finish(self) -> tuple[int, str]:
        """(cost, letters not yet settled) of the best sequence that the automaton accepts."""
        ends = [self.alive[s] for s in (START, ASSISTANT) if s in self.alive]
        best = min(ends, key=lambda e: e[0])
        for cost, node in ends:
            if cost == best[0] and self.tree.less(node, best[1]):
                best = cost, node
        return best[0], self.tree.path(best[1])
