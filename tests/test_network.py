"""The node network: layers against plain loops and finite differences, and its training over Spark."""
import math

import numpy as np
import pytest

from domframe.operators import network, training
from domframe.operators.network import Batch, Lists, Nodes, Settings


def batch(r, s, count=5, near=(2, 3, 1, 2, 4)):
    """Random nodes with neighbours, lists of unlike lengths, empty ones too."""
    total = count + (sum(near) if s.neighbors else 0)
    some = lambda n, top, least=0: Lists.of([r.integers(0, top, r.integers(least, 5)) for _ in range(n)])
    path = some(count, s.tags, 1)
    first = np.concatenate(([0], np.cumsum(near))) if s.neighbors else np.zeros(count + 1, np.int64)
    nodes = Nodes(some(total * s.lists, s.words), r.integers(0, s.tags, total), r.normal(size=(total, s.dense)), some(total, s.words))
    return Batch(nodes, count, first, r.normal(size=(int(first[-1]), s.edge)), path, some(len(path.ids), s.words), r.integers(0, s.classes, count))


SHAPES = [
    Settings(12, 6, 3, dense=2, word_dim=3, tag_dim=2, lstm_dim=2, lists=3, attrs=True, neighbors=True, path_tag_dim=2, path_dim=2, path_attrs=True, hidden=(5, 4), smoothing=0.1, layer_norm=True),
    Settings(12, 6, 3, word_dim=3, tag_dim=2, word_function="mean", neighbors=True, normalize="vector", hidden=(4,)),
    Settings(12, 6, 2, word_dim=3, tag_dim=2, word_function="sum", hidden=()),
]


@pytest.mark.parametrize("s", SHAPES)
def test_gradients_equal_finite_differences(s):
    r = np.random.default_rng(1)
    b, params = batch(r, s), network.initial(s, 3)

    def loss(p):
        t = network.Tape(p)
        return t.loss(network.logits(t, s, b), b.y, s.smoothing)

    t = network.Tape(params)
    t.loss(network.logits(t, s, b), b.y, s.smoothing)
    dense, sparse = t.gradients()
    whole = {k: dense.get(k, np.zeros_like(v)) for k, v in params.items()}
    for name, (ids, g) in sparse.items():
        whole[name][ids] += g
    assert set(dense) | set(sparse) == set(params)
    for name, value in params.items():
        for at in [np.unravel_index(i, value.shape) for i in r.choice(value.size, min(12, value.size), replace=False)]:
            if name == "words" and at[0] == 0:
                continue
            ends = []
            for d in (1e-6, -1e-6):
                moved = dict(params)
                moved[name] = value.copy()
                moved[name][at] += d
                ends.append(loss(moved))
            assert whole[name][at] == pytest.approx((ends[0] - ends[1]) / 2e-6, abs=1e-5), (name, at)


def one_by_one(params, name, x):
    """States of one sequence, step by step with plain numbers."""
    out = []
    size = params[f"{name}.h"].shape[0]
    h, c = [0.0] * size, [0.0] * size
    for row in x:
        z = [sum(row[i] * params[f"{name}.x"][i][k] for i in range(len(row))) + sum(h[i] * params[f"{name}.h"][i][k] for i in range(size)) + params[f"{name}.b"][0][k] for k in range(4 * size)]
        gate = lambda v: 1 / (1 + math.exp(-v))
        c = [gate(z[size + k]) * c[k] + gate(z[k]) * math.tanh(z[2 * size + k]) for k in range(size)]
        h = [gate(z[3 * size + k]) * math.tanh(c[k]) for k in range(size)]
        out.append(h)
    return np.array(out).reshape(-1, size)


def test_words_are_encoded_by_their_true_lengths():
    s = Settings(20, 2, 2, word_dim=4, lstm_dim=3)
    params = network.initial(s, 5)
    lists = [[3, 4, 5, 6, 7, 8], [], [9], [1, 2], [0], [3, 4, 5, 6, 7, 8]]
    got = network.text_vectors(network.Tape(params, keep=False), s, Lists.of(lists)).value
    for k, ids in enumerate(lists):
        x = params["words"][ids]
        want = np.concatenate([one_by_one(params, "text.ahead", x).mean(axis=0), one_by_one(params, "text.back", x[::-1]).mean(axis=0)]) if ids else np.zeros(6)
        assert np.allclose(got[k], want, atol=1e-9)
        alone = network.text_vectors(network.Tape(params, keep=False), s, Lists.of([ids])).value
        assert np.allclose(alone[0], got[k], atol=1e-12)  # longer ones beside it change nothing


def test_dropout_keeps_the_mean():
    t = network.Tape({}, np.random.default_rng(1))
    x = t.dropout(network.Var(np.ones((400, 50))), 0.3).value
    assert x.mean() == pytest.approx(1, abs=0.02) and set(np.unique(x)) == {0.0, 1 / 0.7}


def test_adam_against_its_definition():
    state = training.State({"w": np.array([[1.0, -2.0]])}, {"w": np.zeros((1, 2))}, {"w": np.zeros((1, 2))}, 0, 0, 9.0)
    o = training.Optimizer(rate=0.1, decay=0.01, clip=0.5)
    m, v, w = np.zeros(2), np.zeros(2), np.array([1.0, -2.0])
    for k, g in enumerate(([3.0, 4.0], [0.1, 0.0]), 1):
        state = training.updated(state, o, {"w": np.array([g])})
        g = np.array(g)
        g = g * min(1, 0.5 / (np.linalg.norm(g) + 1e-6)) + 0.01 * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - 0.1 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
        assert np.allclose(state.params["w"], w, atol=1e-12)


SCHEMA = f"id bigint, {training.INPUT}, y int"


def task(spark, n=240, seed=2):
    """The class is that of the neighbour nearest to a node, of which the node itself shows nothing; word order tells the third."""
    r = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        kind = int(r.integers(0, 2))
        near = [([[int(r.integers(1, 5))]], 1 + (kind if k == 0 else int(r.integers(0, 2))), [], [0.0], [float(k), 0.0, float(k)]) for k in range(3)]
        words = [[5, 6]] if r.random() < 0.3 else [[6, 5]]
        rows.append((i, words, 0, [], [0.0], [0, 1, 2], [[], [1], []], near, 2 if words == [[5, 6]] else kind))
    return spark.createDataFrame(rows, SCHEMA)


SHAPE = Settings(8, 4, 3, dense=1, word_dim=6, tag_dim=4, lstm_dim=6, neighbors=True, path_dim=2, path_attrs=True, hidden=(16,), dropout=0.0, head_dropout=0.1)
FAST = training.Optimizer(rate=0.03, clip=5.0)


def test_training_over_spark(spark, tmp_path):
    rows = task(spark).repartition(3)
    folder = training.sliced(rows, ["id"], 2, f"{tmp_path}/slices")
    held = spark.read.parquet(folder)
    # a step's gradient is that of all its rows at once
    params = network.initial(SHAPE, 1)
    loss, n, grads = training.gathered(training.summed(held, SHAPE, params, None), params)
    assert n == 240
    table = held.toArrow().combine_chunks().to_batches()[0]
    b = training.batch_of(SHAPE, table)
    t = network.Tape(params)
    assert loss == pytest.approx(t.loss(network.logits(t, SHAPE, b), b.y, 0.0) / 240)
    dense, sparse = t.gradients()
    assert all(np.allclose(grads[k] * 240, g) for k, g in dense.items())
    assert all(np.allclose(grads[k][ids] * 240, g) for k, (ids, g) in sparse.items())
    # stopped after an epoch and resumed: the same parameters, bit by bit
    whole, log = training.train(spark, folder, rows, SHAPE, FAST, training.started(SHAPE, 1), 2, 2, checkpoints=f"{tmp_path}/whole")
    training.train(spark, folder, rows, SHAPE, FAST, training.started(SHAPE, 1), 1, 2, checkpoints=f"{tmp_path}/half")
    state, shape = training.load(spark, training.latest(spark, f"{tmp_path}/half"))
    assert shape == SHAPE and (state.step, state.epoch) == (2, 1)
    resumed, _ = training.train(spark, folder, rows, SHAPE, FAST, state, 2, 2)
    assert all((resumed.params[k] == v).all() and (resumed.second[k] == whole.second[k]).all() for k, v in whole.params.items())
    assert [x[0] for x in log] == ["train_loss", "train_loss", "val_loss"] * 2 and log[-1][2] < log[2][2]


def test_neighbours_help(spark, tmp_path):
    """With attention the classes are found; without, only the one that word order tells."""
    train_, test = task(spark, 240, 3), task(spark, 200, 4)
    right = {}
    for near in (True, False):
        s = SHAPE._replace(neighbors=near, path_dim=0, head_dropout=0.0)
        folder = training.sliced(train_, ["id"], 1, f"{tmp_path}/{near}")
        state, _ = training.train(spark, folder, None, s, FAST, training.started(s, 1), 25, 1)
        got = training.predict(test, s, state.params, ["id"]).join(test.select("id", "y"), "id").toPandas()
        right[near] = (got.predicted == got.y).mean()
        assert ((got[got.y == 2].predicted == 2).mean()) > 0.95  # two words in one order
    assert right[True] > 0.95 and right[False] < 0.8


def test_loss_falls_to_the_closed_form(spark, tmp_path):
    """Without inputs the best network gives the classes' shares; with smoothing, their smoothed ones."""
    rows = [(i, [[0]], 0, [], [], [0], [[]], [], int(i % 4 == 0)) for i in range(80)]
    s = Settings(2, 1, 2, word_dim=2, tag_dim=2, word_function="none", hidden=(), dropout=0.0, smoothing=0.2)
    folder = training.sliced(spark.createDataFrame(rows, SCHEMA), ["id"], 1, f"{tmp_path}/rows")
    state, log = training.train(spark, folder, None, s, training.Optimizer(rate=0.1, clip=None), training.started(s, 1), 40, 1)
    p = 0.25 * 0.8 + 0.1
    assert [x[2] for x in log if x[0] == "train_loss"][-1] == pytest.approx(-p * math.log(p) - (1 - p) * math.log(1 - p), abs=1e-3)


def test_paths_are_encoded_like_each_alone(spark):
    from domframe.operators import paths

    r = np.random.default_rng(4)
    names = ["html", "body", "div", "p", "a", "-text"]
    lists = [["html", *r.choice(names[1:], r.integers(0, 9)).tolist()] for _ in range(60)] + [["html"], ["html", "new"], []]
    lists += lists[:20]
    nodes = spark.createDataFrame(list(enumerate(lists)), "id bigint, path array<string>")
    tags = spark.createDataFrame([(x, k + 1) for k, x in enumerate(names)], "tag string, id int")
    s = Settings(1, 7, 2, path_tag_dim=3, path_dim=4)
    params = network.initial(s, 2)
    number = {x: k + 1 for k, x in enumerate(names)}
    got = {x.id: np.array(x.vector) for x in paths.encoded_paths(nodes, tags, params, ["id"]).collect()}
    for k, path in enumerate(lists):
        alone = network.path_vectors(network.Tape(params, keep=False), s, Lists.of([[number.get(x, 0) for x in path]]), Lists.of([])).value[0]
        assert np.allclose(got[k], alone, atol=1e-9)
    assert len(got) == len(lists)
    distinct = {tuple(p[: k + 1]) for p in lists for k in range(len(p))}
    assert paths.prefixes(nodes.select("path")).count() == len(distinct)


SF = "/root/testdata/sf0.001"


def test_word_encoder_of_documents(spark):
    from domframe.plans import network_queries as q
    from domframe.plans.catalogue import QUERIES
    from domframe.plans.registry import Tables

    got = {r.doc_id: np.array(r.vector) for r in QUERIES["word_encoder"].plan(spark, SF).collect()}
    words = {r.doc_id: list(r.ids) for r in q.document_words(Tables(spark, SF)).collect()}
    assert set(got) == set(words) == {r[0] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect()}
    params = network.initial(q.ENCODER, 7)
    for k in sorted(words, key=lambda k: len(words[k]))[::20]:
        x = params["words"][[0 if i == 0 else i % q.BUCKETS + 1 for i in words[k]]]
        want = np.concatenate([one_by_one(params, "text.ahead", x).mean(axis=0), one_by_one(params, "text.back", x[::-1]).mean(axis=0)])
        assert np.allclose(got[k], want, atol=1e-5)


def test_nodes_without_words_stay(spark):
    from domframe.operators import features

    rows = spark.createDataFrame([(1, ["a", "b", "c"]), (2, []), (3, None), (4, ["zz"]), (None, ["a"])], "k bigint, t array<string>")
    words = spark.createDataFrame([("a", 1), ("b", 2)], "token string, id bigint")
    got = {r.k: list(r.ids) for r in features.token_ids(rows, "k", "t", words, 2).collect()}
    assert got == {1: [1, 2], 2: [0], 3: [0], 4: [0], None: [0]}
    assert {r.k: list(r.ids) for r in features.token_ids(rows, "k", "t", words, known_only=True).collect()}[1] == [1, 2]


def test_ancestors_have_their_attribute_words(spark):
    from domframe.operators import inputs

    kind = "page_id bigint, node_id int, tag string, text string, is_text boolean, attrs map<string,string>, anc_ids array<int>, anc_tags array<string>"
    nodes = spark.createDataFrame([(1, 0, "html", None, False, {"class": "main box"}, [], []), (1, 1, "p", None, False, {}, [0], ["html"]), (1, 2, "-text", "box x", True, {}, [0, 1], ["html", "p"])], kind)
    words = spark.createDataFrame([("box", 1), ("main", 2), ("x", 3)], "token string, id bigint")
    tags = spark.createDataFrame([("html", 1), ("p", 2), ("-text", 3)], "tag string, id int")
    r = inputs.assembled(nodes.where("is_text"), words, tags, attributes=["class"], around=nodes).first()
    assert (r.words, r.path, r.path_attrs, r.neighbors) == ([[1, 3]], [1, 2, 3], [[2, 1], [0], [0]], [])


def test_network_of_pages(spark):
    from domframe.plans.catalogue import QUERIES

    got = QUERIES["network_train_predict"].plan(spark, SF).toPandas()
    held_out = got[got.page_id % 2 == 1]
    assert len(held_out) and (held_out.y == held_out.predicted).mean() > 0.9
    for y in (1, 2):
        part = held_out[held_out.y == y]
        assert (part.predicted == y).mean() > 0.8, y


def test_node_word_ids(spark):
    from domframe.operators import html
    from domframe.plans.catalogue import QUERIES

    nodes = html.dom_nodes(spark.read.parquet(f"{SF}/pages.parquet")).toPandas()
    got = QUERIES["node_word_ids"].plan(spark, SF).toPandas()
    assert len(got) == len(nodes) and (got.ids[~nodes.set_index(["page_id", "node_id"]).is_text.reindex(list(zip(got.page_id, got.node_id, strict=True))).to_numpy(dtype=bool)] == "0").all()


def test_equal_texts_of_a_batch_are_encoded_once(monkeypatch):
    s = network.Settings(9, 3, 2, word_dim=3, tag_dim=2, lstm_dim=2, lists=2, dropout=0.0, head_dropout=0.0)
    params = network.initial(s, 3)
    lists = [[1, 2, 3], [4], [1, 2, 3], [4], [5, 6], []]

    def batch(of, y):
        n = len(y)
        none = network.Lists.of([[]] * n)
        return network.Batch(network.Nodes(network.Lists.of(of), np.ones(n, np.int64), np.zeros((n, 0)), none), n, np.zeros(n + 1, np.int64), np.zeros((0, 3)), none, none, np.array(y))

    def gradients(b):
        t = network.Tape(params)
        loss = t.loss(network.logits(t, s, b), b.y, 0.0)
        dense, tables = t.gradients()
        ids, words = tables["words"]
        return loss, dense["text.ahead.h"], dict(zip(ids.tolist(), words.tolist(), strict=True))

    single = [gradients(batch(lists[k : k + 2], [k // 2 % 2])) for k in (0, 2, 4)]
    places, real = [], network.Tape.lstm
    monkeypatch.setattr(network.Tape, "lstm", lambda self, x, first, *a: places.append(len(x.value)) or real(self, x, first, *a))
    loss, h, words = gradients(batch(lists, [0, 1, 0]))
    assert places == [6, 6]
    assert np.isclose(loss, sum(x[0] for x in single)) and np.allclose(h, sum(x[1] for x in single))
    for i in words:
        assert np.allclose(words[i], sum(np.array(x[2].get(i, np.zeros(3))) for x in single)), i


def test_slices_are_files_of_like_size(spark, tmp_path):
    """Each slice is dealt evenly to files, so that no task of a step has most of its rows; no row is lost or doubled."""
    rows = spark.range(20_000).selectExpr("id div 10 as page_id", "id as node_id", "if(id % 7 = 0, null, 1) as y")
    folder = training.sliced(rows, ["page_id", "node_id"], 4, f"{tmp_path}/slices", together=["page_id"])
    held = spark.read.parquet(folder).selectExpr("*", "input_file_name() as file").toPandas()
    assert sorted(held.node_id) == [i for i in range(20_000) if i % 7]
    assert (held.groupby("page_id").file.nunique() == 1).all() and (held.groupby("file").slice.nunique() == 1).all()
    for _, part in held.groupby("slice"):
        sizes = part.groupby("file").size()
        assert len(sizes) >= 8 and sizes.max() < 2 * sizes.mean()


def test_gates_far_out_are_shut_or_open():
    params = {"a.x": np.array([[900.0, -900.0, 900.0, 900.0]]), "a.h": np.zeros((1, 4)), "a.b": np.zeros((1, 4))}
    with np.errstate(all="raise", under="ignore"):
        t = network.Tape(params)
        x = network.Var(np.array([[1.0], [-1.0], [1.0]]))
        out = t.lstm(x, np.array([0, 1, 3]), "a", False)
        out.grad = np.ones_like(out.value)
        t.gradients()
    assert np.allclose(out.value[:, 0], [math.tanh(1), 0, math.tanh(1)]) and np.isfinite(x.grad).all()


def test_packed_rows_give_the_same_gradients(spark, tmp_path, monkeypatch):
    rows = task(spark, 60).coalesce(1)
    params = network.initial(SHAPE, 1)
    training.packed(rows, f"{tmp_path}/packed")
    held = spark.read.parquet(f"{tmp_path}/packed")
    assert held.columns == [training.PACKED]
    plain, packed = (training.gathered(training.summed(x, SHAPE, params, 5), params) for x in (rows, held))
    assert plain[:2] == packed[:2] and all((packed[2][k] == g).all() for k, g in plain[2].items())
    # nested rows are read once for a slice and not in each epoch
    folder = training.sliced(rows, ["id"], 2, f"{tmp_path}/slices")
    nested, real = [], training.packed
    monkeypatch.setattr(training, "packed", lambda df, path: nested.append(path) or real(df, path))
    seen, sums = [], training.summed
    monkeypatch.setattr(training, "summed", lambda df, *a: seen.append(df.columns) or sums(df, *a))
    training.train(spark, folder, None, SHAPE, FAST, training.started(SHAPE, 1), 2, 2)
    assert len(nested) == 2 and seen == [[training.PACKED]] * 4


def test_labels_take_one_pass_over_pages(spark):
    from domframe.operators import html
    from domframe.plans import network_queries as q

    pages = spark.createDataFrame([(1, "u", "<html><body><h1>a<b>c</b></h1><p>b</p><p>d</p></body></html>"), (2, "u", "<html><body><p>x</p></body></html>")], "page_id bigint, url string, html string")
    got = q.labelled(html.dom_nodes(pages))
    assert got._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    assert {(r.page_id, r.text): r.y for r in got.where("is_text").collect()} == {(1, "a"): 1, (1, "c"): 2, (1, "b"): 0, (1, "d"): 0, (2, "x"): 0}
    assert got.where("not is_text and y is not null").count() == 0


def test_friends_of_small_trees_side_by_side(spark):
    from domframe.operators import neighbors

    r = np.random.default_rng(3)
    rows = [(t, i, [0, int(r.integers(1, 3)), 10 + i // 3]) for t in range(30) for i in range(20, 20 + int(r.integers(1, 15)))]
    nodes = spark.createDataFrame(rows, "page_id bigint, node_id bigint, anc_ids array<bigint>").coalesce(1)
    got = {}
    for x in neighbors.friends(nodes, 2, 3).collect():
        got.setdefault((x.page_id, x.node_id), []).append((x.distance, x.friend_id))
    for t, i, up in rows:
        all_ = sorted((abs(j - i), j) for u, j, other in rows if u == t and j != i and set(up[-2:]) & set(other[-2:]))
        assert sorted(got.get((t, i), [])) == all_[:3], (t, i)
