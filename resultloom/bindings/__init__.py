"""How the operators are bound to the benchmark tables, with reference SQL for each."""
