"""How programs run: cutting lineage, loops, checked broadcasts and a look at plans."""
