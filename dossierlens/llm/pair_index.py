"""Merging many words at once through an index from each pair to all its positions."""

import heapq


def merge_words(words: list, merges: dict) -> list:
    """``words`` are lists of symbol ids; returns them with all merges applied, each pair of lowest rank first.

    The symbols of all words lie in one sequence with links to the next and previous symbol of the same word. The index maps
    a rank to the positions where its pair begins; active ranks are taken in ascending order, all positions of a rank are
    merged from left to right, and the pairs that arise beside a merge are entered into the index. A rank that becomes
    active below the current one is taken first. The work is proportional to the number of merges times a logarithm,
    also for words of many thousand bytes.
    """
    symbol, after, before, heads = [], [], [], []
    for word in words:
        at = len(symbol)
        heads.append(at if word else -1)
        symbol += word
        after += range(at + 1, at + len(word) + 1)
        before += range(at - 1, at + len(word) - 1)
        if word:
            after[-1] = before[at] = -1
    index, get = {}, merges.get
    for at, right in enumerate(after):
        if right >= 0 and (found := get((symbol[at], symbol[right]))):
            index.setdefault(found[0], []).append(at)
    active = list(index)
    heapq.heapify(active)
    while active:
        rank = heapq.heappop(active)
        positions = index.pop(rank)
        if len(positions) > 1:
            positions.sort()
        # A position names its pair only as long as nothing there was merged, so the pair is looked up once it is current.
        first = second = joined = -1
        for k, at in enumerate(positions):
            right = after[at]
            if right < 0:
                continue
            left = symbol[at]
            if left != first or symbol[right] != second:
                found = get((left, symbol[right]))
                if not found or found[0] != rank:
                    continue
                first, second, joined = left, symbol[right], found[1]
            symbol[at], symbol[right] = joined, -1
            beyond = after[at] = after[right]
            after[right] = -1
            lower = rank
            if beyond >= 0:
                before[beyond] = at
                if found := get((joined, symbol[beyond])):
                    other = found[0]
                    if other in index:
                        index[other].append(at)
                    else:
                        index[other] = [at]
                        heapq.heappush(active, other)
                    if other < lower:
                        lower = other
            if (prior := before[at]) >= 0 and (found := get((symbol[prior], joined))):
                other = found[0]
                if other in index:
                    index[other].append(prior)
                else:
                    index[other] = [prior]
                    heapq.heappush(active, other)
                if other < lower:
                    lower = other
            if lower < rank:
                if rank not in index:
                    heapq.heappush(active, rank)
                index.setdefault(rank, []).extend(positions[k + 1:])
                break
    out = []
    for at in heads:
        word = []
        while at >= 0:
            word.append(symbol[at])
            at = after[at]
        out.append(word)
    return out


def merge_word(symbols: list, merges: dict) -> list:
    """The same for one short word: the ranks of neighbours are kept in a list whose smallest entry is merged first."""
    get, none = merges.get, (1 << 60, -1)
    symbols = list(symbols)
    found = [get(pair, none) for pair in zip(symbols, symbols[1:])]
    while found:
        best = min(found)
        if best is none or best[1] < 0:
            break
        k = found.index(best)
        symbols[k: k + 2] = [best[1]]
        del found[k]
        if k < len(found):
            found[k] = get((symbols[k], symbols[k + 1]), none)
        if k:
            found[k - 1] = get((symbols[k - 1], symbols[k]), none)
    return symbols
