"""What a worker holds at once does not grow with its batch."""

import numpy as np
import public_tokenizers

from siftlake.llm import sampling


def test_cuts_are_learnt_in_parts_with_the_same_samples(monkeypatch):
    model = public_tokenizers.path("piece_bpe_32k.model")
    rng = np.random.default_rng(5)
    texts = [" ".join("".join(rng.choice(list("abcdeinrst"), 7)) for _ in range(60)) for _ in range(40)]

    def drawn():
        sampling._stores.clear()
        s = sampling.Sampler(model, texts, list(range(len(texts))), 1e-3, 1)
        return [[(s.ids(o, e).tolist(), lp) for o, e, lp, _ in x] for x in s.top(2)[0]]

    whole, sizes, learn = drawn(), [], sampling.Store._learn
    monkeypatch.setattr(sampling, "LEARNT", 1000)
    monkeypatch.setattr(sampling.Store, "_learn", lambda self, new: (sizes.append(sum(map(len, new))), learn(self, new)))
    assert drawn() == whole and len(sizes) > 10 and max(sizes) <= 1000 + max(map(len, texts))
