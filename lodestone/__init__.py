"""Record-linkage analytics on Spark: normalise, tokenise, block, score, evaluate, write."""
