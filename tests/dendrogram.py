"""Condensed tree and selection of one run from its whole dendrogram, in one process:
what the Spark jobs are compared with."""

import numpy as np

_INF = float("inf")


def eom_labels(pids: np.ndarray, edges, min_cluster_size: int) -> np.ndarray:
    n = len(pids)
    labels = np.full(n, -1, dtype=np.int64)
    if n < 2 or len(edges) == 0:
        return labels
    index = {int(p): i for i, p in enumerate(pids)}
    e = edges.sort_values(["w", "a", "b"], kind="mergesort")
    parent = list(range(2 * n))
    size = [1] * n + [0] * n
    children = {}
    dist = {}
    nxt = n

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b, w in zip(e["a"], e["b"], e["w"]):
        ra, rb = find(index[int(a)]), find(index[int(b)])
        if ra == rb:
            continue
        node = nxt
        nxt += 1
        parent[ra] = parent[rb] = node
        size[node] = size[ra] + size[rb]
        children[node] = (ra, rb)
        dist[node] = w
    roots = {find(i) for i in range(n)}

    def lam(d):
        return _INF if d <= 0 else 1.0 / d

    def leaves(node):
        out, stack = [], [node]
        while stack:
            x = stack.pop()
            if x < n:
                out.append(x)
            else:
                stack.extend(children[x])
        return out

    next_label = 0
    for root in sorted(roots):
        if root < n:
            continue
        # condensed tree: cluster -> (birth lambda, points with fall-out lambda, child clusters)
        clusters = {0: {"birth": 0.0, "points": [], "kids": [], "size": size[root]}}
        stack = [(root, 0)]
        while stack:
            node, cid = stack.pop()
            if node < n:
                clusters[cid]["points"].append((node, clusters[cid]["birth"]))
                continue
            l, r = children[node]
            lv = lam(dist[node])
            sl, sr = size[l], size[r]
            if sl >= min_cluster_size and sr >= min_cluster_size:
                for ch in (l, r):
                    nid = len(clusters)
                    clusters[nid] = {"birth": lv, "points": [], "kids": [], "size": size[ch]}
                    clusters[cid]["kids"].append(nid)
                    stack.append((ch, nid))
            elif sl < min_cluster_size and sr < min_cluster_size:
                for ch in (l, r):
                    clusters[cid]["points"].extend((p, lv) for p in leaves(ch))
            else:
                small, big = (l, r) if sl < min_cluster_size else (r, l)
                clusters[cid]["points"].extend((p, lv) for p in leaves(small))
                stack.append((big, cid))
        # stability
        stab = {}
        for cid, c in clusters.items():
            s = 0.0
            b = c["birth"]
            for _, lv in c["points"]:
                s += (min(lv, 1e300) - b)
            for k in c["kids"]:
                s += clusters[k]["size"] * (clusters[k]["birth"] - b)
            stab[cid] = s
        # excess of mass, leaves up; the root cluster is not selectable
        selected = {}
        for cid in sorted(clusters, reverse=True):
            kids = clusters[cid]["kids"]
            if not kids:
                selected[cid] = True
                continue
            child_sum = sum(stab[k] for k in kids)
            if cid != 0 and stab[cid] >= child_sum:
                selected[cid] = True
                stack2 = list(kids)
                while stack2:
                    k = stack2.pop()
                    selected[k] = False
                    stack2.extend(clusters[k]["kids"])
            else:
                selected[cid] = False
                stab[cid] = child_sum
        if len(clusters) == 1:
            continue  # no split ever reached min_cluster_size: all noise
        for cid in sorted(c for c, sel in selected.items() if sel):
            stack3 = [cid]
            members = []
            while stack3:
                k = stack3.pop()
                members.extend(p for p, _ in clusters[k]["points"])
                stack3.extend(clusters[k]["kids"])
            labels[members] = next_label
            next_label += 1
    return labels
