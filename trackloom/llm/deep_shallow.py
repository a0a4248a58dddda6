"""Deep-shallow sorting of strings: multikey quicksort to a shallow depth, then blind tries."""

from __future__ import annotations

SHALLOW = 16
#: Bytes that one comparison of the multikey quicksort looks at.
PIECE = 8


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    x = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (x.bit_length() + 7) // 8


def _blind_trie(strings: list[bytes], ids: list[int]) -> list[int]:
    """Ids in the order of their strings, by insertion into a trie whose nodes know only a depth.

    A node is [depth, {byte at depth: child}], the byte -1 standing for the end of a string; a leaf
    is a tuple of equal strings' ids. A search skips the bytes between nodes, so it compares the
    string it ends at once, finds the true common depth and branches there.
    """
    root: list | tuple = (ids[0],)
    for new in ids[1:]:
        s = strings[new]
        node = root
        while isinstance(node, list):
            d = node[0]
            child = node[1].get(s[d] if d < len(s) else -1)
            node = next(iter(node[1].values())) if child is None else child
        t = strings[node[0]]
        depth = common_prefix(s, t)
        equal = depth == len(s) == len(t)
        parent, key, node = None, None, root
        while isinstance(node, list) and (node[0] < depth or equal):
            parent, key = node, (s[node[0]] if node[0] < len(s) else -1)
            node = node[1][key]
        if equal:
            made: list | tuple = (*node, new)
        elif isinstance(node, list) and node[0] == depth:
            node[1][s[depth] if depth < len(s) else -1] = (new,)
            continue
        else:
            made = [depth, {(t[depth] if depth < len(t) else -1): node, (s[depth] if depth < len(s) else -1): (new,)}]
        if parent is None:
            root = made
        else:
            parent[1][key] = made
    out: list[int] = []
    stack = [root]
    while stack:
        node = stack.pop()
        if isinstance(node, tuple):
            out.extend(node)
        else:
            stack.extend(child for _, child in sorted(node[1].items(), key=lambda x: x[0], reverse=True))
    return out


def sort_strings(strings: list[bytes], shallow: int = SHALLOW) -> list[int]:
    """Indices of the strings in ascending order."""
    done: list[int] = []
    stack = [(list(range(len(strings))), 0)]
    while stack:
        ids, depth = stack.pop()
        if len(ids) < 2:
            done.extend(ids)
        elif depth >= shallow:
            done.extend(_blind_trie(strings, ids))
        else:
            pieces = {i: strings[i][depth : depth + PIECE] for i in ids}
            pivot = pieces[ids[len(ids) // 2]]
            less = [i for i in ids if pieces[i] < pivot]
            same = [i for i in ids if pieces[i] == pivot]
            more = [i for i in ids if pieces[i] > pivot]
            ended = len(pivot) < PIECE
            stack.append((more, depth))
            stack.append((same, shallow if ended else depth + PIECE))
            stack.append((less, depth))
    return done


def with_prefixes(strings: list[bytes]) -> tuple[list[int], list[int]]:
    """The sorted order, and the common prefix of each string with the one before it (0 for the first)."""
    order = sort_strings(strings)
    return order, [0, *(common_prefix(strings[a], strings[b]) for a, b in zip(order, order[1:]))]
