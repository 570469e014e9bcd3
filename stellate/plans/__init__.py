"""The four subject areas: card leakage, bill payments, trauma access, retail sales."""
