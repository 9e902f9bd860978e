import random

import pytest
from kmerloom.__main__ import main


def rc(s):
    return s.translate(str.maketrans("ACGT", "TGCA"))[::-1]


def test_assemble_eval_and_qc(spark, tmp_path, capsys):
    rng = random.Random(5)
    g = "".join(rng.choice("ACGT") for _ in range(500))
    pairs = [(g[s : s + 80], rc(g[s + 60 : s + 140])) for s in range(0, 360, 6)]
    for m in (0, 1):
        (tmp_path / f"r{m + 1}.fq").write_text("".join(f"@r{i}/{m + 1}\n{p[m]}\n+\n{'I' * 80}\n" for i, p in enumerate(pairs)))
    one, two, out = str(tmp_path / "r1.fq"), str(tmp_path / "r2.fq"), str(tmp_path / "out")
    main(["qc", "-1", one, "-2", two, "-o", out, "--json", f"{out}/qc.json"], spark)
    assert "clean_n_reads" in capsys.readouterr().out
    main(["assemble", "-1", f"{out}/clean_1.fastq.gz", "-2", f"{out}/clean_2.fastq.gz", "-o", out, "-k", "21", "-c", "2", "-m", "100"], spark)
    lines = (tmp_path / "out" / "contigs.fasta").read_text().split("\n")
    found = "".join(x for x in lines if not x.startswith(">"))
    assert sum(x.startswith(">") for x in lines) == 1
    assert found in g or found in rc(g)
    (tmp_path / "ref.fa").write_text(f">g\n{g}\n")
    main(["eval", f"{out}/contigs.fasta", "-r", str(tmp_path / "ref.fa"), "-l", "100"], spark)
    assert "genome_fraction" in capsys.readouterr().out


def test_bad_options(spark, tmp_path):
    for options in (["-o", "x"], ["-1", "a", "-o", "x"], ["-i", "a", "--meta", "--rna", "-o", "x"], ["--12", "a", "-s", "b", "-o", "x"]):
        with pytest.raises(ValueError):
            main(["assemble", *options], spark)
