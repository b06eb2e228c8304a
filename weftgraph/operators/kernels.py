"""Sequential algorithms over a :class:`~weftgraph.operators.local.Local` graph; each yields result rows."""

from __future__ import annotations

import heapq
import math
from collections import deque
from itertools import count

import numpy as np


class StopSearch(Exception):
    """A visitor ends the search."""


class PruneSearch(Exception):
    """A visitor asks not to go further from here."""


# --- depth-first structure ---------------------------------------------------------------------


def _lowpoints(g):
    """Iterative DFS over an undirected graph: (disc, low, parent edge, order, component edge stacks)."""
    disc, low, via, order = {}, {}, {}, []
    clock = count()
    blocks, stack_edges = [], []
    cut = set()
    for root in g.ids:
        if root in disc:
            continue
        disc[root] = low[root] = next(clock)
        via[root] = None
        stack, kids = [(root, iter(g.out[root]))], 0
        order.append(root)
        while stack:
            v, it = stack[-1]
            for x, _, eid in it:
                if via[v] is not None and eid == via[v][1] or x == v:
                    continue
                if x not in disc:
                    via[x] = (v, eid)
                    stack_edges.append(eid)
                    disc[x] = low[x] = next(clock)
                    order.append(x)
                    stack.append((x, iter(g.out[x])))
                    break
                if disc[x] < disc[v]:
                    stack_edges.append(eid)
                    low[v] = min(low[v], disc[x])
            else:
                stack.pop()
                if stack:
                    p = stack[-1][0]
                    low[p] = min(low[p], low[v])
                    kids += p == root
                    if low[v] >= disc[p]:
                        block = []
                        while True:
                            e = stack_edges.pop()
                            block.append(e)
                            if e == via[v][1]:
                                break
                        blocks.append(block)
                        if p != root:
                            cut.add(p)
        if kids > 1:
            cut.add(root)
    return disc, low, via, order, blocks, cut


def articulation(g):
    return [(v,) for v in sorted(_lowpoints(g)[5])]


def bridges(g):
    disc, low, via, *_ = _lowpoints(g)
    ends = {e: (u, v) for e, u, v, _ in g.edges}
    return [ends[p[1]] for v, p in via.items() if p and low[v] > disc[p[0]]]


def biconnected(g):
    ends = {e: (u, v) for e, u, v, _ in g.edges}
    return [(*ends[e], min(block)) for block in _lowpoints(g)[4] for e in block]


def chains(g, source=None):
    """Schmidt's chains: for each vertex in DFS order, its back edges, each followed up the tree to a visited vertex."""
    disc, _, via, order, *_ = _lowpoints(g)
    if source is not None:
        part = {source}
        todo = [source]
        while todo:
            for x in g.neighbors(todo.pop()):
                if x not in part:
                    part.add(x)
                    todo.append(x)
        sub = type(g)(part, [e for e in g.edges if e[1] in part], False)
        sub.ids.remove(source)
        sub.ids.insert(0, source)
        disc, _, via, order, *_ = _lowpoints(sub)
    rows, visited, n = [], set(), 0
    tree = {p[1] for p in via.values() if p}
    for v in order:
        for x, _, eid in g.out[v]:
            if eid in tree or x == v or disc[x] < disc[v]:
                continue
            visited.add(v)
            pos, a, b = 0, v, x
            rows.append((n, pos, a, b))
            while b not in visited:
                visited.add(b)
                a, b, pos = b, via[b][0], pos + 1
                rows.append((n, pos, a, b))
            n += 1
    return rows


def cycle_basis(g, root=None):
    """Fundamental cycles of a spanning forest; self-loops are cycles of one vertex."""
    up, depth, out = {}, {}, []
    for r in ([root] if root is not None else []) + (g.ids if root is None else []):
        if r in depth:
            continue
        depth[r], up[r], todo = 0, None, deque([r])
        while todo:
            v = todo.popleft()
            for x, _, eid in g.out[v]:
                if x not in depth:
                    depth[x], up[x] = depth[v] + 1, (v, eid)
                    todo.append(x)
    tree = {p[1] for p in up.values() if p}
    seen = set()
    for eid, u, v, _ in g.edges:
        if eid in tree or u not in depth or v not in depth or (min(u, v), max(u, v)) in seen:
            continue
        if any(p and p[0] in (u, v) and c in (u, v) for c, p in ((u, up[u]), (v, up[v]))) and u != v:
            continue
        seen.add((min(u, v), max(u, v)))
        left, right, a, b = [u], [v], u, v
        while a != b:
            if depth[a] >= depth[b]:
                a = up[a][0]
                left.append(a)
            else:
                b = up[b][0]
                right.append(b)
        out.append((left + right[-2::-1] if u != v else [u],))
    return out


def simple_cycles(g):
    """Elementary cycles by blocked search from the least vertex of each strong component; a self-loop is one cycle."""
    out = [([v],) for v in g.ids if any(x == v for x, *_ in g.out[v])]
    adj = {v: sorted(set(g.neighbors(v)) - {v}) for v in g.ids}
    for s in g.ids:
        allowed = _strong(adj, s, {v for v in g.ids if v >= s})
        if len(allowed) < 2:
            continue
        path, blocked, later = [s], {s}, {}
        stack = [(s, iter([x for x in adj[s] if x in allowed]), [False])]

        def free(v, blocked=blocked, later=later):
            todo = [v]
            while todo:
                x = todo.pop()
                if x in blocked:
                    blocked.discard(x)
                    todo += later.pop(x, ())

        while stack:
            v, it, hit = stack[-1]
            for x in it:
                if x == s:
                    out.append((list(path),))
                    hit[0] = True
                elif x not in blocked:
                    path.append(x)
                    blocked.add(x)
                    stack.append((x, iter([y for y in adj[x] if y in allowed]), [False]))
                    break
            else:
                stack.pop()
                path.pop()
                if hit[0]:
                    free(v)
                    if stack:
                        stack[-1][2][0] = True
                else:
                    for x in adj[v]:
                        if x in allowed:
                            later.setdefault(x, set()).add(v)
    return out


def _strong(adj, s, within):
    """The strong component of ``s`` inside a vertex set."""
    def walk(nexts):
        seen, todo = {s}, [s]
        while todo:
            for x in nexts(todo.pop()):
                if x in within and x not in seen:
                    seen.add(x)
                    todo.append(x)
        return seen

    back = {}
    for v in within:
        for x in adj[v]:
            back.setdefault(x, []).append(v)
    return walk(lambda v: adj[v]) & walk(lambda v: back.get(v, ()))


def strong_components(g):
    """(id, least id of its strong component): a depth-first search whose path is cut into components as it grows."""
    when, ends, path, got = {}, [], [], {}
    for root in g.ids:
        if root in when:
            continue
        todo = [(root, iter(g.out[root]))]
        when[root] = len(when)
        path.append(root)
        ends.append(root)
        while todo:
            v, arcs = todo[-1]
            for x, *_ in arcs:
                if x not in when:
                    when[x] = len(when)
                    path.append(x)
                    ends.append(x)
                    todo.append((x, iter(g.out[x])))
                    break
                if x not in got:  # on the path: all that was opened after x is one with it
                    while when[ends[-1]] > when[x]:
                        ends.pop()
            else:
                todo.pop()
                if ends[-1] == v:
                    ends.pop()
                    block = []
                    while not block or block[-1] != v:
                        block.append(path.pop())
                    least = min(block)
                    got.update((y, least) for y in block)
    return list(got.items())


def find_cycle(g, source=None):
    """The first cycle that a depth-first search closes."""
    state = {}
    for root in [source] if source is not None else g.ids:
        if root in state:
            continue
        path, stack = [root], [iter(g.neighbors(root))]
        state[root] = 1
        while stack:
            for x in stack[-1]:
                if state.get(x) == 1:
                    loop = path[path.index(x) :] + [x]
                    return [(i, a, b) for i, (a, b) in enumerate(zip(loop, loop[1:], strict=False))]
                if x not in state:
                    state[x] = 1
                    path.append(x)
                    stack.append(iter(g.neighbors(x)))
                    break
            else:
                stack.pop()
                state[path.pop()] = 2
    return []


def dfs_edges(g, source=None):
    seen, rows, pos = set(), [], count()
    for root in [source] if source is not None else g.ids:
        if root in seen:
            continue
        seen.add(root)
        stack = [(root, iter(g.neighbors(root)))]
        while stack:
            v, it = stack[-1]
            x = next((x for x in it if x not in seen), None)
            if x is None:
                stack.pop()
                continue
            seen.add(x)
            rows.append((next(pos), v, x))
            stack.append((x, iter(g.neighbors(x))))
    return rows


def dfs_forest(g, source=None):
    """(vertex, parent, edge, number in preorder, the last number below it, depth) of every vertex met; a root is its own parent, by edge 0."""
    rows, at = [], {}
    for root in [source] if source is not None else g.ids:
        if root in at:
            continue
        at[root] = len(rows)
        rows.append([root, root, 0, len(rows), 0, 0])
        stack = [(root, iter(g.out[root]))]
        while stack:
            v, it = stack[-1]
            x, _, eid = next((a for a in it if a[0] not in at), (None, None, None))
            if x is None:
                rows[at[v]][4] = len(rows) - 1
                stack.pop()
                continue
            at[x] = len(rows)
            rows.append([x, v, eid, len(rows), 0, len(stack)])
            stack.append((x, iter(g.out[x])))
    return [tuple(r) for r in rows]


class _Recorder:
    def __init__(self, visitor):
        self.rows, self.visitor, self.pos = [], visitor, count()

    def __call__(self, event, *args):
        src = dst = node = w = None
        if len(args) == 1 and isinstance(args[0], tuple):
            src, dst, w = args[0]
        else:
            node = args[0]
            w = float(args[1]) if len(args) > 1 else None
        self.rows.append((next(self.pos), event, node, src, dst, w))
        hook = getattr(self.visitor, event, None)
        if hook is not None:
            hook(*args)


def _sources(g, sources):
    return list(g.ids) if sources is None else list(sources)


def bfs_events(g, sources, visitor=None):
    tell, colour = _Recorder(visitor), {}
    try:
        for s in _sources(g, sources):
            if s in colour:
                continue
            colour[s] = "gray"
            todo = deque()
            try:
                tell("discover_vertex", s)
                todo.append(s)
            except PruneSearch:
                pass
            while todo:
                v = todo.popleft()
                for x, w, _ in g.out[v]:
                    e = (v, x, w)
                    if x not in colour:
                        try:
                            tell("tree_edge", e)
                            colour[x] = "gray"
                            tell("discover_vertex", x)
                            todo.append(x)
                        except PruneSearch:
                            continue
                    else:
                        try:
                            tell("non_tree_edge", e)
                            tell(f"{colour[x]}_target_edge", e)
                        except PruneSearch:
                            continue
                colour[v] = "black"
                tell("finish_vertex", v)
    except StopSearch:
        pass
    return tell.rows


def dfs_events(g, sources, visitor=None):
    tell, colour, clock = _Recorder(visitor), {}, count()
    try:
        for s in _sources(g, sources):
            if s in colour:
                continue
            stack = []

            def enter(v, stack=stack):
                colour[v] = "gray"
                kids = iter(g.out[v])
                try:
                    tell("discover_vertex", v, next(clock))
                except PruneSearch:
                    kids = iter(())
                stack.append((v, kids))

            enter(s)
            while stack:
                v, it = stack[-1]
                for x, w, _ in it:
                    e = (v, x, w)
                    try:
                        if x not in colour:
                            tell("tree_edge", e)
                            enter(x)
                            break
                        tell("back_edge" if colour[x] == "gray" else "forward_or_cross_edge", e)
                    except PruneSearch:
                        continue
                else:
                    stack.pop()
                    colour[v] = "black"
                    try:
                        tell("finish_vertex", v, next(clock))
                    except PruneSearch as err:
                        raise RuntimeError("a finish hook cannot prune") from err
    except StopSearch:
        pass
    return tell.rows


def dijkstra_events(g, sources, visitor=None):
    tell, done = _Recorder(visitor), set()
    try:
        for s in _sources(g, sources):
            if s in done:
                continue
            best, heap, tie = {s: 0.0}, [(0.0, 0, s)], count(1)
            while heap:
                d, _, v = heapq.heappop(heap)
                if v in done:
                    continue
                done.add(v)
                try:
                    tell("discover_vertex", v, d)
                    for x, w, _ in g.out[v]:
                        try:
                            tell("examine_edge", (v, x, w))
                            if x in done:
                                continue
                            if x not in best or d + w < best[x]:
                                tell("edge_relaxed", (v, x, w))
                                best[x] = d + w
                                heapq.heappush(heap, (d + w, next(tie), x))
                            else:
                                tell("edge_not_relaxed", (v, x, w))
                        except PruneSearch:
                            continue
                except PruneSearch:
                    pass
                tell("finish_vertex", v)
    except StopSearch:
        pass
    return tell.rows


# --- shortest paths ----------------------------------------------------------------------------


def bfs(g, s):
    dist, todo = {s: 0}, deque([s])
    while todo:
        v = todo.popleft()
        for x, *_ in g.out[v]:
            if x not in dist:
                dist[x] = dist[v] + 1
                todo.append(x)
    return dist


def dijkstra(g, s, reverse=False, length=None):
    """Distances and the parent on a shortest path; of equal ones the first found by (distance, id)."""
    arcs, best, via, heap = g.into if reverse else g.out, {s: 0.0}, {s: None}, [(0.0, s)]
    done = set()
    while heap:
        d, v = heapq.heappop(heap)
        if v in done:
            continue
        done.add(v)
        for x, w, _ in arcs[v]:
            n = d + (w if length is None else length(w))
            if x not in best or n < best[x]:
                best[x], via[x] = n, v
                heapq.heappush(heap, (n, x))
    return best, via


class _Negative(Exception):
    def __init__(self, cycle):
        super().__init__("negative cycle")
        self.cycle = cycle


def bellman_ford(g, s):
    """Queue-based relaxation; raises with the cycle if one of negative length is reached."""
    best, via, hops, todo, queued = {s: 0.0}, {s: None}, {s: 0}, deque([s]), {s}
    while todo:
        v = todo.popleft()
        queued.discard(v)
        for x, w, _ in g.out[v]:
            if x not in best or best[v] + w < best[x] - 1e-12 * max(1.0, abs(best[x])):
                best[x], via[x], hops[x] = best[v] + w, v, hops[v] + 1
                if hops[x] >= len(g.ids):
                    raise _Negative(_follow(via, x, len(g.ids)))
                if x not in queued:
                    queued.add(x)
                    todo.append(x)
    return best, via


def _follow(via, v, n):
    for _ in range(n):
        v = via[v] if via[v] is not None else v
    loop, x = [v], via[v]
    while x is not None and x != v and len(loop) <= n:
        loop.append(x)
        x = via[x]
    return [v, *loop[:0:-1], v] if len(loop) > 1 else [v, v]


def path_to(via, t):
    out = [t]
    while via[t] is not None:
        t = via[t]
        out.append(t)
    return out[::-1]


def negative_cycle(g):
    """A negative cycle of the whole graph, or None: all vertices start at distance 0."""
    best, via, last = dict.fromkeys(g.ids, 0.0), dict.fromkeys(g.ids), None
    arcs = [(v, x, w) for v in g.ids for x, w, _ in g.out[v]]
    for _ in range(len(g.ids)):
        last = None
        for v, x, w in arcs:
            if best[v] + w < best[x] - 1e-12 * max(1.0, abs(best[x])):
                best[x], via[x], last = best[v] + w, v, x
        if last is None:
            return None
    for _ in g.ids:
        last = via[last]
    loop, x = [last], via[last]
    while x != last:
        loop.append(x)
        x = via[x]
    return [last, *loop[:0:-1], last]


def k_shortest(g, s, k):
    """The k-th shortest walk length from s to each vertex that k walks reach."""
    seen, heap = dict.fromkeys(g.ids, 0), [(0.0, s)]
    out = {}
    while heap:
        d, v = heapq.heappop(heap)
        if seen[v] >= k:
            continue
        seen[v] += 1
        if seen[v] == k:
            out[v] = d
        for x, w, _ in g.out[v]:
            if seen[x] < k:
                heapq.heappush(heap, (d + w, x))
    return out


def astar(g, s, is_goal, estimate):
    best, via, heap, done = {s: 0.0}, {s: None}, [(estimate(s), 0, s)], set()
    tie = count(1)
    while heap:
        _, _, v = heapq.heappop(heap)
        if is_goal(v):
            return path_to(via, v)
        if v in done:
            continue
        done.add(v)
        for x, w, _ in g.out[v]:
            n = best[v] + w
            if x not in best or n < best[x]:
                best[x], via[x] = n, v
                done.discard(x)
                heapq.heappush(heap, (n + estimate(x), next(tie), x))
    return None


def floyd_warshall(g):
    """Matrices of distances and next vertices, ids in order; parallel arcs take the least."""
    import numpy as np

    n, at = len(g.ids), {v: i for i, v in enumerate(g.ids)}
    d = np.full((n, n), np.inf)
    for v in g.ids:
        for x, w, _ in g.out[v]:
            d[at[v], at[x]] = min(d[at[v], at[x]], w)
    nxt = np.tile(np.arange(n), (n, 1))
    d[range(n), range(n)] = np.minimum(d.diagonal(), 0.0) if n else []
    for k in range(n):
        through = d[:, k, None] + d[None, k, :]
        better = through < d
        d = np.where(better, through, d)
        nxt = np.where(better, nxt[:, k, None], nxt)
    return d, nxt


# --- centrality kernels ------------------------------------------------------------------------


def brandes(g, s):
    """Dependencies of all vertices and edges on paths from s (breadth first, parallel edges count)."""
    dist, sigma, preds, order, todo = {s: 0}, {s: 1.0}, {s: []}, [], deque([s])
    while todo:
        v = todo.popleft()
        order.append(v)
        for x, _, eid in g.out[v]:
            if x not in dist:
                dist[x], sigma[x], preds[x] = dist[v] + 1, 0.0, []
                todo.append(x)
            if dist[x] == dist[v] + 1:
                sigma[x] += sigma[v]
                preds[x].append((v, eid))
    delta, edges = dict.fromkeys(order, 0.0), {}
    for x in reversed(order):
        for v, eid in preds[x]:
            c = sigma[v] / sigma[x] * (1 + delta[x])
            edges[eid] = edges.get(eid, 0.0) + c
            delta[v] += c
    return order, delta, edges, sigma, dist


# --- topological kernels -----------------------------------------------------------------------


def lexicographic(g, keys, reverse=False, initial=None):
    """Kahn's algorithm with a heap by (key, id)."""
    out, into = (g.into, g.out) if reverse else (g.out, g.into)
    need = {v: len(into[v]) for v in g.ids}
    heap = [(keys[v], v) for v in (g.ids if initial is None else initial) if initial is not None or not need[v]]
    heapq.heapify(heap)
    order = []
    while heap:
        _, v = heapq.heappop(heap)
        order.append(v)
        for x, *_ in out[v]:
            need[x] -= 1
            if need[x] == 0:
                heapq.heappush(heap, (keys[x], x))
    return [(i, v) for i, v in enumerate(order)]


def topological(g):
    return lexicographic(g, {v: 0 for v in g.ids})


def bicolor_runs(g, passes, colours):
    """Blocks of nodes between edges of two colours. ``passes``: True, False or None per node; ``colours``: eid to colour or None."""
    open_, pending, blocks = {}, {}, []
    for _, v in topological(g):
        ok = passes.get(v)
        if ok is None:
            continue
        cs = [c for c in (colours.get(e) for _, _, e in g.out[v]) if c is not None]
        mine = list(dict.fromkeys(cs))
        if not ok:
            for c in dict.fromkeys([*mine, *(k for k in (colours.get(e) for *_, e in g.into[v]) if k is not None)]):
                block = open_.pop(c, None)
                if block is not None:
                    for k in [k for k, b in open_.items() if b is block]:
                        del open_[k]
                pending.pop(c, None)
            continue
        if len(mine) == 1:
            (c,) = mine
            (open_[c] if c in open_ else pending.setdefault(c, [])).append(v)
        elif len(mine) == 2:
            a, b = mine
            if a in open_ and open_.get(b) is open_[a]:
                open_[a].append(v)
                continue
            block = []
            for c in (a, b):
                old = open_.pop(c, None)
                if old is not None:
                    for k in [k for k, x in open_.items() if x is old]:
                        del open_[k]
                block += pending.pop(c, [])
            block.append(v)
            open_[a] = open_[b] = block
            blocks.append(block)
    return [(b,) for b in blocks]


def dominators(g, start):
    """Immediate dominators by iteration over reverse postorder; the start is its own."""
    post, seen, stack = [], {start}, [(start, iter(g.neighbors(start)))]
    while stack:
        v, it = stack[-1]
        x = next((x for x in it if x not in seen), None)
        if x is None:
            post.append(v)
            stack.pop()
        else:
            seen.add(x)
            stack.append((x, iter(g.neighbors(x))))
    rank = {v: i for i, v in enumerate(post)}
    idom = {start: start}

    def meet(a, b):
        while a != b:
            while rank[a] < rank[b]:
                a = idom[a]
            while rank[b] < rank[a]:
                b = idom[b]
        return a

    moved = True
    while moved:
        moved = False
        for v in reversed(post[:-1]):
            new = None
            for p, *_ in g.into[v]:
                if p in idom:
                    new = p if new is None else meet(p, new)
            if idom.get(v) != new:
                idom[v], moved = new, True
    return idom


def frontiers(g, start):
    idom, out = dominators(g, start), {}
    for v in idom:
        out.setdefault(v, set())
        preds = {p for p, *_ in g.into[v] if p in idom}
        if len(preds) >= 2:
            for p in preds:
                while p != idom[v]:
                    out.setdefault(p, set()).add(v)
                    p = idom[p]
    return out


# --- cuts, planarity ---------------------------------------------------------------------------


def min_cut(g):
    """Maximum-adjacency phases over a matrix of weights; the lightest cut of a phase and one side of it."""
    n = len(g.ids)
    if n < 2:
        return []
    at = {v: i for i, v in enumerate(g.ids)}
    w = np.zeros((n, n))
    for _, u, v, c in g.edges:
        if u != v and not math.isnan(c):
            w[at[u], at[v]] += c
            w[at[v], at[u]] += c
    groups, live, best = [[v] for v in g.ids], np.arange(n), None
    while len(live) > 1:
        m = w[np.ix_(live, live)]
        pull, open_ = m[0].copy(), np.ones(len(live), dtype=bool)
        pull[0], open_[0], before, last = -np.inf, False, 0, 0
        for _ in range(len(live) - 1):
            before, last = last, int(pull.argmax())
            cut = float(pull[last])
            pull[last], open_[last] = -np.inf, False
            np.add(pull, m[last], out=pull, where=open_)
        s, t = live[before], live[last]
        if best is None or cut < best[0]:
            best = (cut, sorted(groups[t]))
        groups[s] += groups[t]
        w[s] += w[t]
        w[:, s] += w[:, t]
        w[s, s] = 0.0
        live = np.delete(live, last)
    return [best]


def planar(g):
    """Each block is embedded face by face (Demoucron, Malgrange, Pertuiset); it fails when a bridge fits no face."""
    pairs = {(min(u, v), max(u, v)) for _, u, v, _ in g.edges if u != v}
    if len(g.ids) < 5 or len(pairs) < 9:
        return True
    if len(pairs) > 3 * len(g.ids) - 6:
        return False
    simple = type(g)(g.ids, [(i, u, v, 1.0) for i, (u, v) in enumerate(sorted(pairs))], False)
    ends = {e: (u, v) for e, u, v, _ in simple.edges}
    return all(_embeds([ends[e] for e in block]) for block in _lowpoints(simple)[4])


def _embeds(edges):
    adj = {}
    for u, v in edges:
        adj.setdefault(u, set()).add(v)
        adj.setdefault(v, set()).add(u)
    n, m = len(adj), len(edges)
    if m < 9 or n < 5:
        return True
    if m > 3 * n - 6:
        return False
    # any cycle to begin with
    root = next(iter(adj))
    up, stack, cycle = {root: None}, [root], None
    path_of = {root: [root]}
    while stack and cycle is None:
        v = stack.pop()
        for x in adj[v]:
            if x not in path_of:
                up[x] = v
                path_of[x] = path_of[v] + [x]
                stack.append(x)
            elif up[v] != x:
                a, b = path_of[v], path_of[x]
                k = 0
                while k < min(len(a), len(b)) and a[k] == b[k]:
                    k += 1
                cycle = a[k - 1 :] + b[: k - 1 : -1] if k < len(b) else a[a.index(x) :]
                break
    inside, done = set(cycle), {frozenset(e) for e in zip(cycle, cycle[1:] + cycle[:1], strict=True)}
    faces = [list(cycle), list(cycle)]
    while len(done) < m:
        parts, seen = [], set()
        for u, v in edges:
            if frozenset((u, v)) not in done and u in inside and v in inside:
                parts.append(({u, v}, [u, v]))
        for v in adj:
            if v in inside or v in seen:
                continue
            comp, todo, touch = {v}, [v], set()
            while todo:
                y = todo.pop()
                for x in adj[y]:
                    if x in inside:
                        touch.add(x)
                    elif x not in comp:
                        comp.add(x)
                        todo.append(x)
            seen |= comp
            a = next(iter(touch))
            # a path through the part between two of its contacts
            prev, queue, end = {a: None}, deque([a]), None
            while queue and end is None:
                y = queue.popleft()
                for x in adj[y]:
                    if x in prev or (y == a and x not in comp):
                        continue
                    if x in comp:
                        prev[x] = y
                        queue.append(x)
                    elif x in touch and y != a:
                        prev[x], end = y, x
                        break
            parts.append((touch, path_to(prev, end)))
        best = None
        for touch, path in parts:
            fits = [f for f in faces if touch <= set(f)]
            if not fits:
                return False
            if best is None or len(fits) < best[0]:
                best = (len(fits), fits[0], path)
        _, face, path = best
        i, j = face.index(path[0]), face.index(path[-1])
        mid = path[1:-1]
        if i < j:
            one, two = face[i : j + 1] + mid[::-1], face[j:] + face[: i + 1] + mid
        else:
            one, two = face[j : i + 1] + mid, face[i:] + face[: j + 1] + mid[::-1]
        faces.remove(face)
        faces += [one, two]
        inside |= set(path)
        done |= {frozenset(e) for e in zip(path, path[1:], strict=False)}
    return True


# --- matching and colouring --------------------------------------------------------------------


class _Matching:
    """Greatest-weight matching of a general graph by duals of vertices and odd sets.

    Edges are arrays, and every round finds the tight ones and the next change of the duals by one
    vectorised pass over them, so memory is linear in vertices and edges. Vertices are 0..n-1, odd
    sets n, n+1, ...; ``top`` and ``side`` (0 free, 1 outer, 2 inner) tell of every vertex the
    outermost set that holds it and that set's place in the search.
    """

    def __init__(self, n, edges, by_number):
        import numpy as np

        self.np, self.n, self.by_number = np, n, by_number
        self.a, self.b, self.w = (np.array([e[k] for e in edges], np.int64) for k in range(3))
        self.y = np.full(n, max(0, int(self.w.max())), np.int64)  # twice the usual dual (as is z), so that all stays whole
        self.z = {}
        self.top, self.side = np.arange(n), np.zeros(n, np.int8)
        self.mate, self.base = [-1] * n, dict(enumerate(range(n)))
        self.kids, self.ties, self.holder, self.link = {}, {}, {}, {}
        self.fresh = count(n)

    def slack(self):
        return self.y[self.a] + self.y[self.b] - 2 * self.w

    def members(self, s):
        todo, out = [s], []
        while todo:
            x = todo.pop()
            if x < self.n:
                out.append(x)
            else:
                todo += self.kids[x]
        return out

    def mark(self, s, side):
        self.side[self.members(s)] = side

    def rebase(self, s, v):
        """Match the inside of set ``s`` so that ``v`` is its only vertex without a partner there."""
        todo = [(s, v)]
        while todo:
            s, v = todo.pop()
            if s < self.n or self.base[s] == v:
                continue
            kid = v
            while self.holder[kid] != s:
                kid = self.holder[kid]
            kids, ties = self.kids[s], self.ties[s]
            i = kids.index(kid)
            # the pairs on the even way from the kid of v to the old base change over
            for j in range(0, i, 2) if i % 2 == 0 else range(i + 1, len(kids), 2):
                p, q = ties[j]
                self.mate[p], self.mate[q] = q, p
                todo += [(kids[j], p), (kids[(j + 1) % len(kids)], q)]
            todo.append((kid, v))
            self.kids[s], self.ties[s], self.base[s] = kids[i:] + kids[:i], ties[i:] + ties[:i], v

    def flip(self, v, partner):
        """Match ``v`` with ``partner`` and change over the pairs on the way from v to its root."""
        while True:
            s = int(self.top[v])
            old = self.mate[self.base[s]]
            self.rebase(s, v)
            self.mate[v] = partner
            if old < 0:
                return
            t = int(self.top[old])
            inner, outer = self.link[t]
            self.rebase(t, inner)
            self.mate[inner] = outer
            v, partner = outer, inner

    def way(self, v):
        """Sets from that of the outer vertex ``v`` up to its root, and the edges between them."""
        sets, steps = [int(self.top[v])], []
        while self.mate[self.base[sets[-1]]] >= 0:
            x = self.base[sets[-1]]
            t = int(self.top[self.mate[x]])
            steps += [(x, self.mate[x]), self.link[t]]
            sets += [t, int(self.top[self.link[t][1]])]
        return sets, steps

    def close(self, u, v):
        """An edge between outer sets: a new odd set if they share a root (False), else a longer matching (True)."""
        (us, ue), (vs, ve) = self.way(u), self.way(v)
        if us[-1] != vs[-1]:
            self.flip(u, v)
            self.flip(v, u)
            return True
        seen = {x: i for i, x in enumerate(us)}
        j = next(j for j, x in enumerate(vs) if x in seen)
        i = seen[vs[j]]
        s = next(self.fresh)
        self.kids[s] = us[: i + 1][::-1] + vs[:j]
        self.ties[s] = [(q, p) for p, q in ue[:i][::-1]] + [(u, v)] + ve[:j]
        self.base[s], self.z[s] = self.base[us[i]], 0
        for x in self.kids[s]:
            self.holder[x] = s
        inside = self.members(s)
        self.top[inside], self.side[inside] = s, 1
        return False

    def open(self, s):
        kids = self.kids.pop(s)
        for x in kids:
            del self.holder[x]
            self.top[self.members(x)] = x
        del self.base[s], self.z[s]
        return kids, self.ties.pop(s)

    def unfold(self, s):
        """An inner set whose dual is used up: its kids on the even way between link and base stay in the search."""
        v, outer = self.link.pop(s)
        kids, ties = self.open(s)
        i, k = kids.index(int(self.top[v])), len(kids)
        for x in kids:
            self.mark(x, 0)
        self.mark(kids[i], 2)
        self.link[kids[i]] = (v, outer)
        back = i % 2 == 0
        for j in range(i, 0, -2) if back else range(i, k, 2):
            if back:
                p, q = ties[j - 2][::-1]
                mid, end = kids[j - 1], kids[j - 2]
            else:
                p, q = ties[j + 1]
                mid, end = kids[j + 1], kids[(j + 2) % k]
            self.mark(mid, 1)
            self.mark(end, 2)
            self.link[end] = (q, p)

    def stage(self):
        """One search; whether it made the matching longer."""
        np = self.np
        self.side[:] = 0
        self.link.clear()
        for s in [s for s, x in self.base.items() if self.mate[x] < 0 and s not in self.holder]:
            self.mark(s, 1)
        while (self.side == 1).any():
            su, sv, apart, slack = self.side[self.a], self.side[self.b], self.top[self.a] != self.top[self.b], self.slack()
            grow = apart & (su + sv == 1)
            meet = apart & (su == 1) & (sv == 1)
            acted = False
            for e in np.flatnonzero((grow | meet) & (slack == 0)):
                u, v = int(self.a[e]), int(self.b[e])
                if self.side[u] != 1:
                    u, v = v, u
                if self.side[u] != 1 or self.side[v] == 2 or self.top[u] == self.top[v]:
                    continue
                acted = True
                if self.side[v] == 1:
                    if self.close(u, v):
                        return True
                else:
                    t = int(self.top[v])
                    self.mark(t, 2)
                    self.link[t] = (v, u)
                    self.mark(int(self.top[self.mate[self.base[t]]]), 1)
            if acted:
                continue
            inner = [s for s in self.z if s not in self.holder and self.side[self.base[s]] == 2]
            steps = [int(slack[grow].min())] if grow.any() else []
            steps += [int(slack[meet].min()) // 2] if meet.any() else []
            steps += [self.z[s] // 2 for s in inner]
            if not self.by_number:
                steps.append(int(self.y[self.side == 1].min()))
            if not steps:
                return False
            d = min(steps)
            self.y[self.side == 1] -= d
            self.y[self.side == 2] += d
            for s in self.z:
                if s not in self.holder:
                    self.z[s] += (0, 2, -2)[self.side[self.base[s]]] * d
            if not self.by_number and not self.y[self.side == 1].min():
                return False
            for s in inner:
                if not self.z[s]:
                    self.unfold(s)
        return False

    def solve(self):
        while self.stage():
            todo = [s for s in self.z if s not in self.holder]
            while todo:
                s = todo.pop()
                if s >= self.n and not self.z[s]:
                    todo += self.open(s)[0]
        return self.mate

    def check(self):
        """Raise unless the duals prove the matching best (in the mode by number: best of its size)."""
        shift = int(self.y.min()) if self.by_number else 0
        around = []
        for v in range(self.n):
            held, x = [], v
            while x in self.holder:
                x = self.holder[x]
                held.append(x)
            around.append(held)
            if self.y[v] < shift or (self.mate[v] < 0 and self.y[v] != shift):
                raise AssertionError(f"dual of vertex {v}")
        for u, v, left in zip(self.a.tolist(), self.b.tolist(), self.slack().tolist(), strict=True):
            left += sum(self.z[s] for s in set(around[u]) & set(around[v]))
            if left < 0 or (left and self.mate[u] == v):
                raise AssertionError(f"slack of edge {u}, {v}")
        for s, z in self.z.items():
            inside = set(self.members(s))
            if z < 0 or (z and sum(self.mate[v] in inside for v in inside) != len(inside) - 1):
                raise AssertionError("an odd set with a dual is not full")


def max_weight_matching(g, max_cardinality=False, verify_optimum=False):
    """Pairs (u, v), u < v, of a matching of greatest weight; with ``max_cardinality`` among those of most pairs."""
    at, best = {v: i for i, v in enumerate(g.ids)}, {}
    for _, u, v, w in g.edges:
        if u != v:
            k = (at[min(u, v)], at[max(u, v)])
            best[k] = max(best.get(k, -math.inf), int(w))
    edges = [(*k, w) for k, w in sorted(best.items()) if max_cardinality or w > 0]
    if not edges:
        return []
    m = _Matching(len(g.ids), edges, max_cardinality)
    mate = m.solve()
    if verify_optimum:
        m.check()
    return [(g.ids[a], g.ids[b]) for a, b in enumerate(mate) if b > a]


def greedy_colors(adj, preset=None, strategy="degree"):
    """Colours of an undirected adjacency {node: set}: by degree, by saturation, or by independent sets."""
    colour = dict(preset or {})
    if strategy == "independent_set":
        left, c = {v for v in adj if v not in colour}, 0
        while left:
            layer, free = set(), {v for v in left if not any(colour.get(x) == c for x in adj[v])}
            while free:
                v = min(free, key=lambda x: (len(adj[x] & free), x))
                layer.add(v)
                free -= adj[v] | {v}
            for v in layer:
                colour[v] = c
            left -= layer
            c += 1
        return colour

    def least(v):
        used = {colour[x] for x in adj[v] if x in colour}
        return next(c for c in count() if c not in used)

    if strategy == "saturation":
        todo = {v for v in adj if v not in colour}
        while todo:
            v = max(todo, key=lambda x: (len({colour[y] for y in adj[x] if y in colour}), len(adj[x]), -x))
            colour[v] = least(v)
            todo.discard(v)
        return colour
    for v in sorted((v for v in adj if v not in colour), key=lambda x: (-len(adj[x]), x)):
        colour[v] = least(v)
    return colour


def edge_fans(g):
    """At most one colour more than the greatest degree (Vizing's fans); simple graphs."""
    colour, used = {}, {v: {} for v in g.ids}

    def free(v):
        return next(c for c in count() if c not in used[v])

    def put(u, v, c):
        old = colour.pop(frozenset((u, v)), None)
        if old is not None:
            for x in (u, v):
                if used[x].get(old) in (u, v):
                    del used[x][old]
        if c is not None:
            colour[frozenset((u, v))] = c
            used[u][c], used[v][c] = v, u

    for _, u, v, _ in g.edges:
        if u == v or frozenset((u, v)) in colour:
            continue
        fan, grown = [v], True
        while grown:
            grown = False
            c = {k for k in range(len(used[fan[-1]]) + len(g.ids)) if k not in used[fan[-1]]}
            for k, x in sorted(used[u].items()):
                if x not in fan and k in c:
                    fan.append(x)
                    grown = True
                    break
        a, b = free(u), free(fan[-1])
        # the path of colours b and a from u is turned over
        path, x, k = [], u, b
        while k in used[x]:
            y = used[x][k]
            path.append((x, y, k))
            x, k = y, a if k == b else b
        for x, y, _ in path:
            put(x, y, None)
        for x, y, k in path:
            put(x, y, a if k == b else b)
        # the first fan vertex at which b is free, with a fan that still holds
        end = 0
        for i, x in enumerate(fan):
            if i and not (k := colour.get(frozenset((u, x)))) in range(10**9):
                break
            if i and k in used[fan[i - 1]]:
                break
            end = i
            if b not in used[x]:
                break
        shift = [colour[frozenset((u, x))] for x in fan[1 : end + 1]]
        for x in fan[1 : end + 1]:
            put(u, x, None)
        for x, k in zip(fan, shift, strict=False):
            put(u, x, k)
        put(u, fan[end], b)
    return [(eid, colour[frozenset((u, v))]) for eid, u, v, _ in g.edges if u != v]


def bipartite_edges(g, left):
    """As many colours as the greatest degree: each edge takes a free colour at both ends, or an alternating path is turned over."""
    colour, used = {}, {v: {} for v in g.ids}
    ends = {e: (u, v) for e, u, v, _ in g.edges}
    upto, holes = dict.fromkeys(g.ids, 0), {}  # the colours below ``upto`` are used, or among the holes

    def free(v):
        gone = holes.get(v, [])
        while gone and gone[0] in used[v]:
            heapq.heappop(gone)
        if gone:
            return gone[0]
        while upto[v] in used[v]:
            upto[v] += 1
        return upto[v]

    for eid, u, v, _ in g.edges:
        a, b = free(u), free(v)
        if a != b and a in used[v]:
            x, k, path = v, a, []
            while k in used[x]:
                e = used[x][k]
                path.append(e)
                x = ends[e][0] if ends[e][1] == x else ends[e][1]
                k = b if k == a else a
            for e in path:
                for y in ends[e]:
                    if used[y].get(colour[e]) == e:
                        del used[y][colour[e]]
                        if colour[e] < upto[y]:
                            heapq.heappush(holes.setdefault(y, []), colour[e])
            for e in path:
                colour[e] = b if colour[e] == a else a
                for y in ends[e]:
                    used[y][colour[e]] = e
        colour[eid] = a
        used[u][a] = used[v][a] = eid
    return sorted(colour.items())


def token_swaps(g, mapping, trials=4, seed=0):
    """Swaps along edges that bring each token to its place; the shortest of several random runs, or a run along a spanning tree if all go in circles."""
    import random

    dist = {t: bfs(g, t) for t in set(mapping.values())}
    if any(v not in dist[t] for v, t in mapping.items()):
        raise ValueError("a token cannot reach its place")
    best = None
    for k in range(trials):
        rng, tok, swaps = random.Random(seed * 1000 + k), dict(mapping), []
        while any(v != t for v, t in tok.items()):
            v = rng.choice(sorted(v for v, t in tok.items() if v != t))
            steps = [x for x in g.neighbors(v) if dist[tok[v]][x] < dist[tok[v]][v]]

            def gain(x, v=v, tok=tok):
                return 2 if x in tok and dist[tok[x]].get(v, 1 << 30) < dist[tok[x]][x] else 1 if x not in tok else 0 if tok[x] != x else -1

            x = max(steps, key=lambda y: (gain(y), rng.random()))
            swaps.append((v, x))
            a, b = tok.pop(v, None), tok.pop(x, None)
            if a is not None:
                tok[x] = a
            if b is not None:
                tok[v] = b
            if len(swaps) > 4 * len(g.ids) ** 2:  # going in circles: this run does not count
                swaps = None
                break
        if swaps is not None and (best is None or len(swaps) < len(best)):
            best = swaps
    if best is None:
        best = _tree_swaps(g, mapping)
    return [(i, a, b) for i, (a, b) in enumerate(best)]


def _tree_swaps(g, mapping):
    """Swaps that always end: leaves of a spanning tree get their token one after the other and drop out. A leaf that
    no token wants gives its own away to the nearest place without one."""
    parent, order = {}, []
    for s in g.ids:
        if s in parent:
            continue
        parent[s], todo = None, deque([s])
        while todo:
            v = todo.popleft()
            order.append(v)
            for x in g.neighbors(v):
                if x not in parent:
                    parent[x] = v
                    todo.append(x)
    near = {v: set() for v in g.ids}
    for v, p in parent.items():
        if p is not None:
            near[v].add(p)
            near[p].add(v)
    tok, swaps = dict(mapping), []
    for leaf in reversed(order):
        start = next((v for v, t in tok.items() if t == leaf), None)
        if start is not None or leaf in tok:
            via, todo = {leaf: None}, deque([leaf])
            while todo and start not in via:
                v = todo.popleft()
                if start is None and v not in tok:
                    start = v
                for x in near[v]:
                    if x not in via:
                        via[x] = v
                        todo.append(x)
            while via[start] is not None:
                x = via[start]
                swaps.append((start, x))
                a, b = tok.pop(start, None), tok.pop(x, None)
                if a is not None:
                    tok[x] = a
                if b is not None:
                    tok[start] = b
                start = x
        for x in near.pop(leaf):
            near[x].discard(leaf)
    return swaps


# --- matching of graphs ------------------------------------------------------------------------


def embeddings(target, pattern, node_ok=None, edge_ok=None, induced=True, exact=False, call_limit=None, id_order=False):
    """Maps of the pattern's vertices into the target that keep edge multiplicities: depth first,
    most constrained vertices first (or by id), candidates from mapped neighbours."""
    def table(g):
        m = {}
        for v in g.ids:
            for x, *_ in g.out[v]:
                m.setdefault((v, x), 0)
                m[v, x] += 1
        return m

    tm, pm = table(target), table(pattern)
    tn = {v: set(target.all_neighbors(v)) for v in target.ids}
    pn = {v: set(pattern.all_neighbors(v)) - {v} for v in pattern.ids}
    if exact and (len(target.ids), len(target.edges)) != (len(pattern.ids), len(pattern.edges)) or len(pattern.ids) > len(target.ids) or len(pattern.edges) > len(target.edges):
        return
    order, left = [], set(pattern.ids)
    while left:
        v = min(left) if id_order else max(left, key=lambda x: (len(pn[x] & set(order)), len(pn[x]), -x))
        order.append(v)
        left.discard(v)
    calls = 0
    fwd, used = {}, set()

    def feasible(p, t):
        if node_ok is not None and not node_ok(t, p):
            return False
        if pm.get((p, p), 0) != tm.get((t, t), 0) and (induced or pm.get((p, p), 0) > tm.get((t, t), 0)):
            return False
        if len(tn[t] - {t}) < len(pn[p]):
            return False
        for q, s in fwd.items():
            for a, b, c, d in ((p, q, t, s), (q, p, s, t)):
                need, have = pm.get((a, b), 0), tm.get((c, d), 0)
                if need > have or induced and need != have:
                    return False
                if need and edge_ok is not None and not edge_ok((c, d), (a, b)):
                    return False
        return True

    def search(depth):
        nonlocal calls
        if depth == len(order):
            yield dict(fwd)
            return
        p = order[depth]
        near = [tn[fwd[q]] for q in pn[p] if q in fwd]
        cands = sorted(set.intersection(*near) if near else target.ids)
        for t in cands:
            if t in used:
                continue
            calls += 1
            if call_limit is not None and calls > call_limit:
                return
            if feasible(p, t):
                fwd[p] = t
                used.add(t)
                yield from search(depth + 1)
                used.discard(t)
                del fwd[p]

    yield from search(0)


# --- layouts -----------------------------------------------------------------------------------


def spring(g, pos=None, fixed=(), k=None, repulsive=2, adaptive=True, rounds=50, tol=1e-6, seed=0):
    """Forces on one vertex at a time, with a step that cools."""
    import random

    rng = random.Random(seed)
    at = {v: list((pos or {}).get(v, (rng.random(), rng.random()))) for v in g.ids}
    n = max(1, len(g.ids))
    k = k or 1 / math.sqrt(n)
    step, energy, progress = 0.1, math.inf, 0
    drop = step / (rounds + 1)
    pull = {}
    for _, u, v, w in g.edges:
        pull.setdefault(u, {})[v] = w
        pull.setdefault(v, {})[u] = w
    for _ in range(rounds):
        total = 0.0
        for v in g.ids:
            if v in fixed:
                continue
            fx = fy = 0.0
            for x in g.ids:
                if x == v:
                    continue
                dx, dy = at[v][0] - at[x][0], at[v][1] - at[x][1]
                d = max(1e-6, math.hypot(dx, dy))
                f = k ** (repulsive + 1) / d**repulsive - pull.get(v, {}).get(x, 0.0) * d * d / k
                fx += f * dx / d
                fy += f * dy / d
            size = math.hypot(fx, fy)
            total += size * size
            if size > 0:
                at[v][0] += step * fx / size
                at[v][1] += step * fy / size
        if adaptive:
            progress = progress + 1 if total < energy else 0
            step = step / 0.9 if progress >= 5 else step if total < energy else step * 0.9
            progress %= 5
            energy = total
        else:
            step -= drop
        if step < tol:
            break
    return at


def kamada_kawai(g, pos=None, fixed=(), rounds=500, inner=10, eps=1e-4):
    """Newton steps on the vertex of the steepest gradient; springs as long as graph distances."""
    ids = [v for v in g.ids]
    if len(ids) < 2:
        return {v: [0.0, 0.0] for v in ids}
    dist = {v: dijkstra(g, v)[0] for v in ids}
    far = max(d for row in dist.values() for d in row.values()) or 1.0
    size = {(a, b): dist[a].get(b, far * 1.5) or 1e-3 for a in ids for b in ids if a != b}
    at = {v: list((pos or {}).get(v, (far / 2 * math.cos(2 * math.pi * i / len(ids)), far / 2 * math.sin(2 * math.pi * i / len(ids))))) for i, v in enumerate(ids)}

    def grad(m):
        gx = gy = hxx = hxy = hyy = 0.0
        for i in ids:
            if i == m:
                continue
            dx, dy = at[m][0] - at[i][0], at[m][1] - at[i][1]
            r = max(1e-9, math.hypot(dx, dy))
            length = size[m, i]
            s = 1 / (length * length)
            gx += s * (dx - length * dx / r)
            gy += s * (dy - length * dy / r)
            hxx += s * (1 - length * dy * dy / r**3)
            hyy += s * (1 - length * dx * dx / r**3)
            hxy += s * length * dx * dy / r**3
        return gx, gy, hxx, hxy, hyy

    for _ in range(rounds):
        m = max((v for v in ids if v not in fixed), key=lambda v: math.hypot(*grad(v)[:2]), default=None)
        if m is None or math.hypot(*grad(m)[:2]) < eps:
            break
        for _ in range(inner):
            gx, gy, hxx, hxy, hyy = grad(m)
            if math.hypot(gx, gy) < eps:
                break
            det = hxx * hyy - hxy * hxy
            if abs(det) < 1e-12:
                at[m][0] -= 0.1 * gx
                at[m][1] -= 0.1 * gy
            else:
                at[m][0] -= (hyy * gx - hxy * gy) / det
                at[m][1] -= (hxx * gy - hxy * gx) / det
    return at
