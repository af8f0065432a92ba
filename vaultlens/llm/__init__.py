"""Training-data operators: token files, mixing, near-dedup, quality, WARC, decontamination, sharding, licences, HTML, line templates."""
