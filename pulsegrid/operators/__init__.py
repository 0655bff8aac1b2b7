"""Operators over long tables; kernels run per group on Arrow batches."""
