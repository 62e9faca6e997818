"""Plain Python answers for small graphs, used to check the Spark operators."""


def build(stages):
    """stages: {id: (status, reason, parents)} -> parents per stage, listed flag."""
    listed = any(parents for _, _, parents in stages.values())
    if listed:
        return {s: sorted(set(p)) for s, (_, _, p) in stages.items()}, True
    ids = sorted(stages)
    return {s: ([ids[i - 1]] if i else []) for i, s in enumerate(ids)}, False


def closure(start, step):
    seen, todo = set(), list(step(start))
    while todo:
        node = todo.pop()
        if node not in seen:
            seen.add(node)
            todo.extend(step(node))
    return seen


def ancestors(parents, stage):
    return closure(stage, lambda s: parents.get(s, []))


def descendants(parents, stage):
    return closure(stage, lambda s: [c for c in parents if s in parents[c]])


def is_acyclic(parents):
    return not any(s in descendants(parents, s) for s in parents)


def depth(parents):
    if not is_acyclic(parents):
        return None

    def level(stage):
        return 1 + max((level(p) for p in parents.get(stage, [])), default=0)

    return max(level(s) for s in parents)


def aborted(stage):
    status, reason, _ = stage
    text = (reason or "").lower()
    return status == "SKIPPED" or "cancelled" in text or "aborted" in text


def analyse(stages):
    """(roots, victims, path, confidence), or None without a failed stage."""
    parents, _ = build(stages)
    failed = {s for s, (status, _, _) in stages.items() if status == "FAILED"}
    if not failed:
        return None
    children = {s: [c for c in parents if s in parents[c]] for s in stages}
    leaves = [s for s in failed if not children[s]]
    last = [s for s in failed if not any(c in failed for c in children[s])]
    terminal = max(leaves or last or failed)
    blame = {s: [p for p in parents[s] if p in failed and not aborted(stages[p])] for s in failed}
    level, frontier = {terminal: 0}, [terminal]
    while frontier:
        following = []
        for stage in frontier:
            for parent in blame[stage]:
                if parent not in level:
                    level[parent] = level[stage] + 1
                    following.append(parent)
        frontier = following
    roots = sorted(s for s in level if not blame[s]) or [terminal]
    victims = sorted(s for s in level if blame[s])
    path = sorted(level, key=lambda s: (level[s], s), reverse=True)
    value = 0.5
    value += 0.2 if any(len(stages[s][1] or "") > 10 for s in roots) else 0
    value += 0.15 if all(len(parents[s]) <= 1 for s in path) else 0
    above = [p for s in roots for p in parents[s] if p in stages]
    value += 0.15 if all(stages[p][0] == "COMPLETED" for p in above) else 0
    value -= 0.1 * max(len(roots) - 2, 0)
    return roots, victims, path, round(min(max(value, 0.0), 1.0), 4)
