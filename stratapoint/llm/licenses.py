"""License scans: MinHash bands over overlapping text windows, then exact shingle containment.

Windows have a template's number of shingles. A window that holds the share ``c`` of the ``d`` distinct
shingles of a template of ``m`` has a Jaccard similarity of at least ``c * d / (m + (1 - c) * d)`` with it, 2/3
at c = 0.8 if none repeats. There are as many bands as make such a window miss its template
in all of them with a probability of ``miss`` at most; bands have two rows, or one where a template repeats so
many shingles that two would ask for very many bands.

A band's rows are minima of the shingle hashes under different exclusive-or masks: on well mixed
hashes each mask is another order.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .passages import PassageParams, item_shingles, per_document, small, windows
from .scratch import Scratch, unpacked

# fixed values: the wording of public license notices
TEMPLATES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"],
    "MIT": ["Released under the MIT License", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"],
    "BSD-3-Clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"],
    "all-rights-reserved": ["All rights reserved"],
}


@dataclass(frozen=True)
class LicenseParams(PassageParams):
    rows: int = 2  # minima of a band, where the least similarity is a half or more; else 1
    miss: float = 1e-5  # chance that a window at the threshold shares no band with its template
    seed: int = 17

    def shape(self, jaccard: float) -> tuple[int, int]:
        """Bands and rows for sets of that similarity at least."""
        rows = self.rows if jaccard >= 0.5 else 1
        return (math.ceil(math.log(self.miss) / math.log1p(-(jaccard**rows))) if jaccard < 1 else 1), rows


def band_values(hs: str, bands: int, rows: int, p: LicenseParams) -> Column:
    """One hash a band, of so many minima of an array of shingle hashes."""
    masks = np.random.default_rng(p.seed).integers(-(2**63), 2**63, bands * rows).tolist()
    under = lambda mask: F.array_min(F.transform(hs, lambda h: h.bitwiseXOR(F.lit(mask))))
    least = [under(m) for m in masks]
    return F.array(*[F.xxhash64(*least[b * rows : (b + 1) * rows]) for b in range(bands)])


def scan_licenses(docs: DataFrame, keep: list[str], text: str, templates: dict[str, list[str]] = TEMPLATES, p: LicenseParams = LicenseParams()) -> DataFrame:
    """Kept columns, n_licenses, licenses (sorted names) and starts (of each match, in words), one row per row of docs.

    A template counts where a window holds the threshold's share of its
    distinct shingles. Null and empty texts have no license. Repeated rows get
    equal results. Kept columns named like a result give way to it.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "licenses")
    listed = [F.struct(F.lit(f"{name}#{i}").alias("item"), F.lit(t).alias("text")) for name, ts in templates.items() for i, t in enumerate(ts)]
    known = item_shingles(spark.range(1).select(F.explode(F.array(*listed)).alias("t")).select("t.*"), "item", "text", scratch, p)
    c = F.lit(p.threshold)
    worst = known.agg(F.min(c * F.col("d") / (F.col("m") + (1 - c) * F.col("d")))).first()[0]
    bands, rows = p.shape(worst or 1.0)
    wins = windows(docs, F.col(f"`{text}`"), known, lambda w, m, d: F.ceil(d * c - 1e-9), scratch, p)
    asking = wins.withColumn("vs", band_values("hs", bands, rows, p)).select("th", "k", "m", "start", "hs", "vs", F.posexplode("vs").alias("band", "value"))
    listed = known.select("row", "k", "m", band_values("hs", bands, rows, p).alias("item_vs")).select("row", "k", "m", "item_vs", F.posexplode("item_vs").alias("band", "value"))
    shared = F.array_position(F.zip_with("vs", "item_vs", lambda x, y: x == y), True) - 1
    pairs = asking.join(small(listed, scratch, p), ["k", "m", "band", "value"]).filter(F.col("band") == shared)  # a pair counts in its first band
    templates_hs = known.select("row", "item", "d", F.col("hs").alias("item_hs"))
    found = pairs.select("th", "start", "hs", "row").join(small(templates_hs, scratch, p), "row").filter(F.size(F.array_intersect("hs", "item_hs")) >= F.ceil(F.col("d") * c - 1e-9))
    found = scratch.save(found.select("th", "item", "start").distinct())
    found = found.select("th", F.split_part("item", F.lit("#"), F.lit(1)).alias("license"), "start")
    out = per_document(docs, keep, ["n_licenses", "licenses", "starts"], F.col(f"`{text}`"), found, [F.array_sort(F.collect_set("license")).alias("licenses"), F.array_sort(F.collect_set(F.struct("start", "license"))).alias("starts")])
    return unpacked(out, F.coalesce(F.size("licenses"), F.lit(0)).alias("n_licenses"), F.coalesce("licenses", F.array().cast("array<string>")).alias("licenses"), F.coalesce("starts", F.array().cast("array<struct<start:int,license:string>>")).alias("starts"))
