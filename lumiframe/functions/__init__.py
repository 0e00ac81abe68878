"""Column expressions and pure-numpy kernels shared by the operators."""
