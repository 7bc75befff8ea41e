"""The formula operations, each with a block kernel and a Column form."""
