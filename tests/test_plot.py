from locusforge import plot


def test_every_contig_counts():
    assert plot.binned(iter([3, 1, 2]), 3) == [3, 1, 2] and plot.binned([], 0) == []
    many = [0] * 4999 + [7]  # the most loci on the last contig by name
    got = plot.binned(many, len(many))
    assert len(got) == plot.WIDTH and got[-1] == 7 and sum(got) == 7
