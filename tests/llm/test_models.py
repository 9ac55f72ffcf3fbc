"""The trained models' arithmetic against plain numpy."""

import numpy as np

from twinline.llm import langid, quality


def plain_log_probs(net, text):
    """Windows of a text, every filter at every place of a window, one sum at a time."""
    text = text + bytes(-len(text) % langid.WINDOW) + bytes(max(langid.WIDTHS) - 1)
    total = np.zeros(len(net.langs))
    for at in range(0, len(text) - max(langid.WIDTHS) + 1, langid.WINDOW):
        tops = []
        for table in net.tables:
            for f in range(table.shape[2]):
                tops.append(max(0.0, max(sum(float(table[j, text[at + p + j], f]) for j in range(len(table))) for p in range(langid.WINDOW))))
        z = np.array(tops) @ net.out.astype(float) + net.bias
        total += z - z.max() - np.log(np.exp(z - z.max()).sum())
    return total


def test_convolution():
    """Languages and probabilities of texts of several windows, and of a part of one, equal a plain convolution."""
    rng = np.random.default_rng(8)
    net = langid.ByteNet(["aa", "bb", "cc"], [rng.normal(0, 0.3, (w, 256, 3)).astype(np.float32) for w in langid.WIDTHS],
                         rng.normal(0, 0.3, (3 * len(langid.WIDTHS), 3)).astype(np.float32), rng.normal(0, 0.1, 3).astype(np.float32))
    texts = [bytes(rng.integers(0, 256, n).astype(np.uint8)) for n in (5, 256, 257, 700)] + [b"", "é".encode() * 40]
    langs, scores = langid.tell(texts, net)
    for text, lang, score in zip(texts, langs, scores):
        if not text:
            assert (lang, score) == ("und", 0.0)
            continue
        p = np.exp(plain_log_probs(net, text))
        assert lang == net.langs[int(p.argmax())] and abs(score - p.max() / p.sum()) < 1e-3
        assert langid.tell([text], net)[1][0] == score  # whatever texts stand beside it


def test_discriminant(spark):
    """Log odds equal densities from determinants and inverses of shrunk covariances computed from all rows at once."""
    rng = np.random.default_rng(4)
    d, n = len(quality.FEATURES), (150, 90)
    x = [rng.normal(k, 1 + k, (m, d)) @ rng.normal(0, 1, (d, d)) for k, m in enumerate(n)]
    rows = spark.createDataFrame([(k, *map(float, r)) for k in (0, 1) for r in x[k]], ["quality", *quality.FEATURES])
    model = quality.fit(rows, 0.2, 0.1)
    every = np.concatenate(x)
    centre, scale = every.mean(0), every.std(0)
    z = [(v - centre) / scale for v in x]
    cov = [np.cov(v.T, bias=True) for v in z]
    pooled = (n[0] * cov[0] + n[1] * cov[1]) / sum(n)
    asked = rng.normal(0, 3, (40, d)) * scale + centre
    dens = []
    for k in (0, 1):
        c = 0.9 * (0.8 * cov[k] + 0.2 * pooled) + 0.1 * np.eye(d)
        away = (asked - centre) / scale - z[k].mean(0)
        dens.append(np.log(n[k] / sum(n)) - 0.5 * np.linalg.slogdet(c)[1] - 0.5 * np.einsum("ij,jk,ik->i", away, np.linalg.inv(c), away))
    assert np.allclose(model.log_odds(asked), dens[1] - dens[0], rtol=1e-6, atol=1e-6)
